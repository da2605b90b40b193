"""The index as files by day: pruning, columns that came later, retention, and engagement that isn't counted twice."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townwire.operators import index_table as it

T0 = datetime(2024, 3, 1)


def made(spark, tmp_path):
    table = it.IndexTable(spark, f"file://{tmp_path}/index", {"cid": T.StringType()})
    rows = [(f"u{i:02}", T0 + timedelta(hours=6 * i), f"c{i}") for i in range(20)]
    table.insert(spark.createDataFrame(rows, "uri string, indexed_at timestamp, cid string"))
    return table


def uris(df):
    return sorted(r["uri"] for r in df.collect())


def test_only_the_asked_days_are_read(spark, tmp_path):
    table = made(spark, tmp_path)
    assert table.days() == [f"2024-03-0{d}" for d in range(1, 6)]
    asked = table.read(F.lit("2024-03-02").cast("date"), F.lit("2024-03-03").cast("date"))
    assert uris(asked) == [f"u{i:02}" for i in range(4, 12)]
    plan = asked._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(indexed_on" in plan.toString()
    asked.collect()
    scan = asked._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters()).size() == 2
    narrow = table.read().select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<uri:string>" in narrow


def test_inserts_are_ignored_where_the_uri_exists(spark, tmp_path):
    table = made(spark, tmp_path)
    more = spark.createDataFrame([("u01", T0, "other"), ("new", T0 + timedelta(days=9), "b"), ("new", T0 + timedelta(days=8), "a"), (None, T0, "x"), ("y", None, "x")], "uri string, indexed_at timestamp, cid string")
    for _ in range(2):
        table.insert(more)
    got = {r["uri"]: (r["cid"], r["indexed_at"]) for r in table.read().collect()}
    assert len(got) == table.read().count() == 21 and got["u01"][0] == "c1" and got["new"] == ("a", T0 + timedelta(days=8))


def test_files_of_an_older_kind_read_with_defaults(spark, tmp_path):
    old = spark.createDataFrame([("a", T0, "c")], "uri string, indexed_at timestamp, cid string").withColumn("indexed_on", F.to_date("indexed_at"))
    path = f"file://{tmp_path}/index"
    old.write.partitionBy("indexed_on").parquet(path)
    table = it.IndexTable(spark, path, {"cid": T.StringType()})
    table.insert(spark.createDataFrame([("b", T0 + timedelta(days=1), "d", 4)], "uri string, indexed_at timestamp, cid string, like_count long"))
    got = {r["uri"]: (r["like_count"], r["repost_count"], r["match_reason"], r["counted_to"]) for r in table.read().collect()}
    assert got == {"a": (0, 0, None, -1), "b": (4, 0, None, -1)}


def test_deletes_and_retention_touch_their_days_only(spark, tmp_path):
    table = made(spark, tmp_path)
    files = lambda day: sorted(p.name for p in (tmp_path / "index" / f"indexed_on={day}").glob("part*"))
    before = {d: files(d) for d in table.days()}
    table.remove(spark.createDataFrame([("u05",), ("nowhere",)], "uri string"))
    after = {d: files(d) for d in table.days()}
    assert {d for d in before if before[d] != after[d]} == {"2024-03-02"} and len(uris(table.read())) == 19
    table.remove(spark.createDataFrame([(f"u{i:02}",) for i in range(8, 12)], "uri string"))
    assert "2024-03-03" not in table.days()
    assert table.retain(T0 + timedelta(days=8, hours=7), days=7) == ["2024-03-01"]
    assert table.days() == ["2024-03-02", "2024-03-04", "2024-03-05"] and uris(table.read()) == ["u06", "u07", *(f"u{i}" for i in range(12, 20))]
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


def test_engagement_is_counted_once(spark, tmp_path):
    table = made(spark, tmp_path)
    path = f"file://{tmp_path}/deltas"
    hour = lambda h: T0 + timedelta(hours=h)
    batches = [
        [("like", "u01", hour(6)), ("like", "u01", hour(5)), ("repost", "u01", hour(7)), ("like", "late", hour(300))],
        [("like", "u01", hour(8)), ("like", "u01", hour(8)), ("like", "u19", hour(200))],
    ]
    frame = lambda rows: spark.createDataFrame(rows, "kind string, subject_uri string, ts timestamp")
    it.write_deltas(frame(batches[0]), path, 0)
    it.write_deltas(frame(batches[0]), path, 0)  # the batch is run again
    table.merge_counts(it.read_deltas(spark, path), 0)
    it.write_deltas(frame(batches[1]), path, 1)
    for _ in range(2):  # so is the merge
        table.merge_counts(it.read_deltas(spark, path), 1)
    counts = lambda: {r["uri"]: (r["like_count"], r["repost_count"]) for r in table.read().collect() if r["like_count"] + r["repost_count"]}
    assert counts() == {"u01": (3, 1), "u19": (1, 0)}
    # a post that comes after its engagement counts all batches
    table.insert(spark.createDataFrame([("late", hour(290), "c")], "uri string, indexed_at timestamp, cid string"))
    table.merge_counts(it.read_deltas(spark, path), 1)
    assert counts() == {"u01": (3, 1), "u19": (1, 0), "late": (1, 0)}
    assert uris(table.read()) == ["late", *(f"u{i:02}" for i in range(20))]


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_of_engagement(spark, tmp_path, files):
    table = made(spark, tmp_path)
    for part in range(3):
        rows = [("like" if i % 2 else "repost", f"u{i % 20:02}", T0 + timedelta(hours=i % 100)) for i in range(part * 40, part * 40 + 40)]
        spark.createDataFrame(rows, "kind string, subject_uri string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("kind string, subject_uri string, ts timestamp").option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    it.engagement_deltas(stream, f"file://{tmp_path}/deltas", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    last = it.read_deltas(spark, f"file://{tmp_path}/deltas").agg(F.max("batch")).first()[0]
    for upto in range(last + 1):
        table.merge_counts(it.read_deltas(spark, f"file://{tmp_path}/deltas"), upto)
    want = {}
    for i in range(120):
        if i % 100 >= 6 * (i % 20):
            want.setdefault(f"u{i % 20:02}", [0, 0])[i % 2 == 0] += 1
    assert {r["uri"]: [r["like_count"], r["repost_count"]] for r in table.read().collect() if r["like_count"] + r["repost_count"]} == want
