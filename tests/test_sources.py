"""Decoding and landed files."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from townwire.sources import commits, files


def message(collection, rkey="k", operation="create", did="d", kind="commit", time_us=1_700_000_000_000_000, **record):
    return json.dumps({"kind": kind, "did": did, "time_us": time_us, "commit": {"collection": collection, "rkey": rkey, "operation": operation, "cid": "c", "record": record or None}})


LINES = [
    message(commits.POST, text="hi", createdAt="2023-11-14T22:13:20Z", langs=["en"], reply={"parent": {"uri": "p"}}, embed={"images": [{"alt": "pic"}]}), message(commits.POST, rkey="k2", operation="delete"),
    message(commits.LIKE, rkey="l", subject={"uri": "at://x"}), message(commits.LIKE, rkey="l2"), message(commits.REPOST, rkey="r", operation="delete", subject={"uri": "at://x"}),
    message("app.other"), message(commits.POST, did=""), message(commits.POST, kind="identity"), "not json", "", "[1]",
]


def test_each_line_is_parsed_once(spark):
    """No test of a field parses the line, or makes it, again: one parser for each of the three kinds of lines."""
    from townwire.plans import rule_queries

    events = commits.decode(commits.parsed(rule_queries.commit_lines(spark, "/root/testdata/sf0.001")))
    assert events._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 3


def test_decode(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    events = commits.decode(commits.parsed(lines))
    assert sorted((r["uri"], r["operation"], r["kind"], r["subject_uri"]) for r in events.collect()) == [
        (f"at://d/{commits.LIKE}/l", "create", "like", "at://x"), (f"at://d/{commits.POST}/k", "create", "post", None), (f"at://d/{commits.POST}/k2", "delete", "post", None),
    ]
    p = commits.posts(events).filter("operation = 'create'").first()
    assert (p["text"], p["alt_text"], p["langs"], p["reply_parent"], p["created_at"]) == ("hi", "pic", ["en"], "p", datetime(2023, 11, 14, 22, 13, 20)) and p["ts"] == p["created_at"]
    assert commits.engagement(events).count() == 1 and commits.malformed(lines).count() == 2


def test_shed(spark):
    df = spark.createDataFrame([("like", 121), ("like", 120), ("post", 999)], "kind string, lag int")
    ingest, ts = F.timestamp_seconds(F.lit(10_000)), F.timestamp_seconds(F.lit(10_000) - F.col("lag"))
    assert sorted(r["lag"] for r in commits.shed(df, ingest, ts, F.col("kind") == "like").collect()) == [120, 999]


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n A \n\nb # note\nA\n  # more\n")
    assert sorted(r["key"] for r in files.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["A", "b # note"]
    assert sorted(r["key"] for r in files.read_list(spark, str(tmp_path / "list.txt"), lower=True).collect()) == ["a", "b # note"]
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "expected": true}\n\n# note\n{"id": "2"}\n')
    assert sorted((r["id"], r["expected"]) for r in files.read_labelled(spark, str(tmp_path / "cases.jsonl")).collect()) == [("1", True), ("2", None)]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n[2]\n')
    assert [r["error"] is None for r in files.read_labelled(spark, str(tmp_path / "bad.jsonl"), strict=False).collect()] == [True, False]
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_labelled(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "array.json").write_text('[{"id": "1", "text": "a"},\n {"id": "2", "text": "b"}]')
    cases = files.read_cases(spark, str(tmp_path / "array.json"))
    assert cases.count() == 2
    files.write_jsonl(cases.select("id", "note"), str(tmp_path / "out"))
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1", "2"] and '"note":null' in spark.read.text(str(tmp_path / "out")).first()["value"]
    bad = files.read_jsonl(spark, str(tmp_path / "cases.jsonl"), files.CASE, strict=False)
    assert bad.filter("error is not null").count() == 1 and bad.count() == 3
    assert bad.select("error").filter("error is not null").first()["error"] == "not a JSON object in cases.jsonl: # note"
    assert [tuple(r) for r in files.numbered_errors(spark, str(tmp_path / "cases.jsonl")).collect()] == [("cases.jsonl", 3, "# note")]
    with pytest.raises(Exception, match="not a JSON object in cases.jsonl"):
        files.read_jsonl(spark, str(tmp_path / "cases.jsonl"), files.CASE).collect()
    files.write_cases(cases.select("id", "text"), str(tmp_path / "cases"))
    assert files.read_cases(spark, str(tmp_path / "cases")).count() == 2 and spark.read.text(str(tmp_path / "cases"), wholetext=True).first()[0].startswith('[{"id":"1"')


def test_payloads(spark):
    view = lambda uri, did, handle, created="2024-01-01T00:00:00Z": {"uri": uri, "author": {"did": did, "handle": handle}, "record": {"text": "t", "createdAt": created}}
    feed = {"actor": "Me.Example", "feed": [{"post": view("u1", "d1", "me.example")}, {"post": view("u2", "d1", "me.example"), "reason": {"$type": "repost"}}, {"post": view("u3", "d2", "you.example")}]}
    df = spark.createDataFrame([(json.dumps(feed),)], "j string").select(F.from_json("j", files.AUTHOR_FEED).alias("p")).select("p.*")
    own = files.author_feed_posts(df)
    assert [r["uri"] for r in own.collect()] == ["u1"]
    search = spark.createDataFrame([(json.dumps({"posts": [view("u4", "d", "h"), view("u5", None, "h"), view("u6", "d", "h", "soon")]}),)], "j string").select(F.from_json("j", files.SEARCH).alias("p")).select("p.*")
    events = files.post_views_to_events(files.search_posts(search))
    assert {r["uri"]: r["status"] for r in events.collect()} == {"u4": "ok", "u5": "bad_payload", "u6": "bad_payload"}
    assert {r["id"]: r["bucket"] for r in files.candidate_rows(own).collect()} == {"u1": "sample"}
    skeleton = spark.createDataFrame([(json.dumps({"feed": [{"post": "b"}, {"post": "a"}]}),)], "j string").select(F.from_json("j", files.SKELETON).alias("p")).select("p.*")
    assert [(r["position"], r["uri"]) for r in files.feed_uris(skeleton).collect()] == [(0, "b"), (1, "a")]
    idx = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2))], "uri string, indexed_at timestamp")
    assert [r["uri"] for r in files.newest(idx, 1).collect()] == ["b"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files of many splits, with empty and long lines: the numbers are those of the whole file."""
    rng = random.Random(6)
    want = set()
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice(['{"id": "1"}', "", "[1]", "x" * rng.randint(1, 300), "  \t", '{"id": "é"}']) for _ in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, i, v) for i, v in enumerate(lines, 1) if v.strip() and not v.startswith("{")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        blocks = files.numbered_lines(spark, str(tmp_path))[1]
        assert blocks.count() > 20
        assert {tuple(r) for r in files.numbered_errors(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
