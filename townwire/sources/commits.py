"""Commit streams: decode JSON lines into post and engagement events. Batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townwire.functions.embeds import alt_text, embed_type
from townwire.functions.times import SHED_LAG_S, event_time, parse_iso
from townwire.operators.rules import once

S = T.StringType()
#: Collections that are read, and the engagement kind of two of them. Fixed values of the public record schemas.
POST, LIKE, REPOST = "app.bsky.feed.post", "app.bsky.feed.like", "app.bsky.feed.repost"
_URI = T.StructType([T.StructField("uri", S)])
RECORD = T.StructType([
    T.StructField("text", S), T.StructField("createdAt", S), T.StructField("langs", T.ArrayType(S)),
    T.StructField("reply", T.StructType([T.StructField("parent", _URI), T.StructField("root", _URI)])),
    T.StructField("embed", embed_type()), T.StructField("subject", _URI),
])
ENVELOPE = T.StructType([
    T.StructField("kind", S), T.StructField("did", S), T.StructField("time_us", T.LongType()),
    T.StructField("commit", T.StructType([T.StructField("collection", S), T.StructField("rkey", S), T.StructField("operation", S), T.StructField("cid", S), T.StructField("record", RECORD)])),
])


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """One column m per line; malformed lines give null fields and fall out in decode. Behind a barrier, as each test of a field would else parse the line, and make it, again."""
    return once(lines, m=F.from_json(F.col(column), ENVELOPE, {"mode": "PERMISSIVE"})).select("m")


def decode(messages: DataFrame) -> DataFrame:
    """Commits that name an author, a key, an operation and a known collection: one tagged frame of posts and engagement."""
    c = F.col("m.commit")
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    whole = messages.filter((F.col("m.kind") == "commit") & given(F.col("m.did")) & given(c["rkey"]) & given(c["operation"]) & c["collection"].isin(POST, LIKE, REPOST))
    is_post, create = c["collection"] == POST, c["operation"] == "create"
    rows = whole.filter(is_post | (create & given(c["record"]["subject"]["uri"])))
    return rows.select(
        F.concat(F.lit("at://"), F.col("m.did"), F.lit("/"), c["collection"], F.lit("/"), c["rkey"]).alias("uri"),
        F.coalesce(c["cid"], F.lit("")).alias("cid"), F.col("m.did").alias("author_did"), c["operation"].alias("operation"), F.col("m.time_us").alias("time_us"),
        F.when(c["collection"] == LIKE, "like").when(c["collection"] == REPOST, "repost").otherwise("post").alias("kind"),
        F.when(~is_post, c["record"]["subject"]["uri"]).alias("subject_uri"), F.when(is_post & create, c["record"]).alias("record"),
    )


def landed(events: DataFrame, path: str) -> DataFrame:
    """Decoded events written once into a new folder, by kind: posts and engagement then read their own files and columns, and no line is parsed again."""
    events.write.partitionBy("kind").parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


def posts(events: DataFrame, *more: str) -> DataFrame:
    """Post events with the columns that gates and cascade read, and more of their own."""
    r = F.col("record")
    return events.filter("kind = 'post'").select(
        "uri", "cid", "author_did", "operation", event_time(F.col("time_us")).alias("ts"), F.coalesce(r["text"], F.lit("")).alias("text"), alt_text(r["embed"]).alias("alt_text"),
        F.coalesce(r["langs"], F.array().cast("array<string>")).alias("langs"), parse_iso(r["createdAt"]).alias("created_at"),
        r["reply"]["parent"]["uri"].alias("reply_parent"), r["reply"]["root"]["uri"].alias("reply_root"), *more,
    )


def engagement(events: DataFrame) -> DataFrame:
    return events.filter("kind <> 'post'").select("kind", "subject_uri", "author_did", "uri", event_time(F.col("time_us")).alias("ts"))


def shed(events: DataFrame, ingest: Column, ts: Column, is_engagement: Column, lag_s: int = SHED_LAG_S) -> DataFrame:
    """Under lag, engagement is left out and posts go on."""
    return events.filter(~is_engagement | (F.unix_micros(ingest) - F.unix_micros(ts) <= lag_s * 1_000_000))


def malformed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that aren't a JSON object, for a dead-letter table."""
    return lines.filter(F.try_parse_json(F.col(column)).isNull())
