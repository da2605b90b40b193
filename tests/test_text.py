"""Text, embed and time functions on literal rows."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from townwire.functions import embeds, text, times


def one(spark, column, **values):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(**{"_": 1, **values})])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("", ""), ("  a \n\t b ", "a b"), ("a b", "a b"), ("a\x1cb", "a b"), (" x", "x")])
def test_normalize(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize(F.col("t"))).first()[0] == want


def test_normalize_runs_of_all_kinds(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices([*text.WHITE, " ", " ", "a", "b"], k=rng.randint(0, 12))) for _ in range(500)]
    got = [r["n"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [re.sub(f"[{text.WHITE}]+", " ", t).strip(" ") for t in texts]


def test_clip_cuts_and_trims(spark):
    assert one(spark, text.clip(F.lit("  " + "x" * 319 + " yz"))) == "x" * 319
    assert one(spark, text.clip(F.lit(None).cast("string"))) == ""


def test_language_tags(spark):
    tags = text.language_tags(F.array(F.lit(" fr_CA "), F.lit(""), F.lit(None), F.lit("EN")))
    assert one(spark, tags) == ["fr-ca", "en"]
    assert one(spark, text.language_tags(F.lit(None).cast("array<string>"))) == []
    assert one(spark, text.has_language(tags, "fr")) and not one(spark, text.has_language(tags, "f"))


def test_handles_go_and_mail_stays(spark):
    assert one(spark, text.normalize(text.without_handles(F.lit("hi @some.name, mail me@x.org")))) == "hi , mail me@x.org"


@pytest.mark.parametrize(("raw", "hit"), [("in Foo!", True), ("foobar", False), ("foö", False), ("Foo️", True), ("(foo)", True), ("foo_x", False), ("new  town", False), ("new town", True), ("FÖHR", True)])
def test_pattern_has_word_edges(spark, raw, hit):
    assert one(spark, F.lit(raw).rlike(text.pattern(["foo", "new town", "föhr"]))) is hit


def alt_texts(spark, *embed_rows):
    df = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in embed_rows], "j string").select("j", embeds.alt_text(F.try_parse_json("j")).alias("x"))
    return [r["x"] for r in df.collect()]


def test_alt_text_order(spark):
    row = {"images": [{"alt": " one "}, {"alt": None}], "external": {"title": "two", "description": "d" * 400}, "record": {"record": {"text": "three", "embed": {"images": [{"alt": "four"}]}}}}
    assert alt_texts(spark, row, {}) == ["one two " + "d" * 320 + " three four", ""]


def test_alt_text_of_any_depth(spark):
    deep = {"images": [{"alt": "end {"}]}
    for i in range(40, 0, -1):
        deep = {"record": {"record": {"text": f"t{i}", "embed": deep}}, "media": {"external": {"title": f"m{i}"}}}
    assert alt_texts(spark, deep) == [" ".join(f"m{i} t{i}" for i in range(1, 41)) + " end {"]
    spaced = json.dumps({"media": {"media": {"media": {"media": {"images": [{"alt": "far"}]}}}}}, indent=1)
    assert alt_texts(spark, spaced) == ["far"]


def test_alt_text_of_missing_and_unexpected_parts(spark):
    value = {"value": {"text": "v"}}
    rows = [{"record": {"record": {}, **value}}, {"record": {"record": None, **value}}, {"record": value}, {"record": {"record": "link", **value}}, {"record": {"record": {"uri": "u"}, **value}}]
    assert alt_texts(spark, *rows) == ["v", "v", "v", "", ""]
    assert alt_texts(spark, "5", '"text"', "[1]", "null", "not json", {"images": "x", "external": {"title": "ok"}}, {"images": [3, {"alt": "a"}]}) == ["", "", "", "", "", "ok", "a"]
    nulls = spark.createDataFrame([(None,), ('{"e": null}',), ('{"e": {"media": {"images": [{"alt": "in"}]}}}',)], "j string").select(embeds.alt_text(F.from_json("j", "e variant")["e"]).alias("x"))
    assert [r["x"] for r in nulls.collect()] == ["", "", "in"]


def test_merged_alt_text(spark):
    assert one(spark, embeds.merged_alt_text(F.lit("a"), F.lit(None), F.lit("a"), F.lit("b"))) == "a b"


def test_times(spark):
    assert one(spark, times.parse_iso(F.lit("2024-05-01T10:00:00+02:00"))) == datetime(2024, 5, 1, 8)
    assert one(spark, times.parse_iso(F.lit("2024-05-01T10:00:00.123456Z"))) == datetime(2024, 5, 1, 10, 0, 0, 123456)
    assert one(spark, times.parse_iso(F.lit("soon"))) is None
    assert one(spark, times.event_time(F.lit(0))) is None
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    day_before, sooner = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:00:00", "2023-12-31 23:59:59"))
    assert not one(spark, times.is_archived(day_before, at)) and one(spark, times.is_archived(sooner, at)) and not one(spark, times.is_archived(F.lit(None).cast("timestamp"), at))
    assert one(spark, times.in_window(at, at, at)) and not one(spark, times.in_window(F.lit(None).cast("timestamp"), at, at))
    assert one(spark, times.lag_seconds(F.lit(3_000_000), F.lit(1_000_000))) == 0.0 and one(spark, times.lag_seconds(F.lit(None).cast("long"), F.lit(1))) is None
    assert times.resume_from(5, 5) == 5 and times.resume_from(0, 901 * 1_000_000) is None and times.resume_from(None, 1) is None


def test_white_space_of_any_kind_is_stripped(spark):
    ends = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    assert all(c.isspace() for c in text.WHITE) and set(ends) <= set(text.WHITE) and {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(text.WHITE)
    df = spark.createDataFrame([(ends + "a b" + ends, [ends + "EN_us" + ends, ends])], "t string, l array<string>")
    row = df.select(text.strip(F.col("t")).alias("t"), text.clip(F.concat("t", F.lit("c" * 400))).alias("c"), text.language_tags(F.col("l")).alias("l")).first()
    assert row["t"] == "a b" and row["l"] == ["en-us"] and row["c"] == ("a b" + ends + "c" * 400)[:320]
    cut = spark.createDataFrame([("x" * 319 + "\u2003y",)], "t string").select(text.clip(F.col("t")).alias("c")).first()["c"]
    assert cut == "x" * 319
