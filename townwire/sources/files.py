"""Landed files: JSON lines, list files, labelled cases, payloads of feeds and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townwire.functions.embeds import embed_type
from townwire.functions.text import strip
from townwire.functions.times import parse_iso
from townwire.sources.commits import RECORD

S = T.StringType()
AUTHOR = T.StructType([T.StructField("did", S), T.StructField("handle", S)])
POST_VIEW = T.StructType([T.StructField("uri", S), T.StructField("cid", S), T.StructField("author", AUTHOR), T.StructField("record", RECORD), T.StructField("embed", embed_type())])
AUTHOR_FEED = T.StructType([
    T.StructField("actor", S), T.StructField("cursor", S),
    T.StructField("feed", T.ArrayType(T.StructType([T.StructField("post", POST_VIEW), T.StructField("reason", T.StructType([T.StructField("$type", S)]))]))),
])
SEARCH = T.StructType([T.StructField("query", S), T.StructField("posts", T.ArrayType(POST_VIEW))])
SKELETON = T.StructType([T.StructField("cursor", S), T.StructField("feed", T.ArrayType(T.StructType([T.StructField("post", S)])))])
CASE = T.StructType([
    *(T.StructField(c, S) for c in ("id", "text", "signal", "bucket", "split", "author_did", "author_handle", "alt_text", "note")),
    *(T.StructField(c, T.BooleanType()) for c in ("expected", "regression", "soft_prior")), T.StructField("langs", T.ArrayType(S)),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines in files of any size, with error: null for good lines, else the file, the line's start and what is wrong. Blank lines are skipped. strict fails on a bad line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(strip(F.col("value")) != "")
    return _objects(lines, schema, strict)


def _objects(lines: DataFrame, schema: T.StructType, strict: bool) -> DataFrame:
    value = strip(F.col("value"))
    is_object = value.startswith("{") & F.try_parse_json(value).isNotNull()
    error = F.when(~is_object, F.concat(F.lit("not a JSON object in "), "file", F.lit(": "), F.substring("value", 1, 80)))
    df = lines.select(F.from_json(value, schema).alias("c"), error.alias("error"))
    if strict:
        df = df.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).isNull()).otherwise(True))
    return df.select("c.*", "error")


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks) of files of any size: lines (file, block, at, value), where at counts within a scan split; blocks (file, block, first, before), how many lines a file has before each of its splits."""
    name, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(name, block, F.monotonically_increasing_id().alias("at"), "value")
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    return lines, counts.select("file", "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def numbered_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are no JSON objects, numbered from 1 in each file. A scan counts the lines of each split, another finds the bad ones, and only these are joined with the sums."""
    lines, blocks = numbered_lines(spark, path)
    value = strip(F.col("value"))
    bad = (value != "") & ~(value.startswith("{") & F.coalesce(F.try_parse_json(value).isNotNull(), F.lit(False)))
    found = lines.filter(bad).join(blocks, ["file", "block"])
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_labelled(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Labelled JSON lines; blank lines and lines from # on are skipped. A line that isn't an object fails, or has error set."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(~strip(F.col("value")).rlike(r"^(#|$)"))
    return _objects(lines, CASE, strict)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation cases."""
    return spark.read.schema(CASE).option("multiLine", True).json(path)


def read_list(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """A list file's keys: stripped lines, each once, without blank ones and those that begin with #."""
    key = strip(F.col("value"))
    return spark.read.text(path).filter(~key.rlike(r"^(#|$)")).select((F.lower(key) if lower else key).alias("key")).distinct()


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines that keep null fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_cases(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file that holds a JSON array, in the order of id. For labelled sets, which people edit: all rows go through one task."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"), "id").coalesce(1).sortWithinPartitions("id")
    joined = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), ",\n ").alias("body"))
    joined.select(F.concat(F.lit("["), "body", F.lit("]")).alias("value")).write.mode(mode).text(path)


def post_views_to_events(views: DataFrame) -> DataFrame:
    """Hydrated posts as create events in event time; status is bad_payload where uri, did, record or creation time is missing."""
    created = parse_iso(F.col("record.createdAt"))
    good = (F.coalesce(F.col("uri"), F.lit("")) != "") & (F.coalesce(F.col("author.did"), F.lit("")) != "") & F.col("record").isNotNull() & created.isNotNull()
    return views.select(
        "uri", F.coalesce("cid", F.lit("")).alias("cid"), F.col("author.did").alias("author_did"), F.col("author.handle").alias("author_handle"), F.lit("create").alias("operation"),
        F.unix_micros(created).alias("time_us"), F.lit("post").alias("kind"), F.lit(None).cast("string").alias("subject_uri"), "record",
        F.when(good, "ok").otherwise("bad_payload").alias("status"),
    )


def author_feed_posts(payloads: DataFrame) -> DataFrame:
    """Posts of author feeds: reposts out, and only the actor's own, by handle or did, case aside."""
    rows = payloads.select("actor", F.explode("feed").alias("item")).filter(F.col("item.reason").isNull() & F.col("item.post").isNotNull())
    own = F.lower("actor").isin(F.lower("item.post.author.handle"), F.lower("item.post.author.did"))
    return rows.filter(own).select("item.post.*")


def search_posts(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.explode("posts").alias("post")).filter(F.col("post.uri").isNotNull()).select("post.*")


def feed_uris(payloads: DataFrame) -> DataFrame:
    """Uris of feed pages in their order."""
    return payloads.select(F.posexplode("feed").alias("position", "item")).select("position", F.col("item.post").alias("uri"))


def newest(index: DataFrame, limit: int | None = None) -> DataFrame:
    """The index, newest first."""
    df = index.orderBy(F.desc("indexed_at"), F.desc("uri"))
    return df if limit is None else df.limit(limit)


def candidate_rows(views: DataFrame, bucket: Column | str = "sample", note: str = "") -> DataFrame:
    """Unlabelled candidates from post views."""
    bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
    return views.select(
        F.col("uri").alias("id"), F.coalesce("record.text", F.lit("")).alias("text"), F.lit(None).cast("boolean").alias("expected"), F.lit("text").alias("signal"), bucket.alias("bucket"),
        F.lit("dev").alias("split"), F.col("author.did").alias("author_did"), F.col("author.handle").alias("author_handle"), F.col("record.langs").alias("langs"), F.lit(note).alias("note"),
    )
