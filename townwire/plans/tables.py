"""The driver's tables as posts, commits and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for rules that take far longer than reading: a table with fewer splits than the session has tasks at once (one file of one row group, say) is dealt out by id; a larger one is left where it is."""
    return dealt(table(spark, sf_dir, "documents"), "doc_id")


def dealt(d: DataFrame, *keys: str) -> DataFrame:
    n = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(n, *keys) if d.rdd.getNumPartitions() < 2 * n else d


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("uri"), "text", F.array("lang").alias("langs"), F.col("source").alias("author_did"))


def key_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their props: the post that engagement is about."""
    return table(spark, sf_dir, "events").withColumn("k", key_of(F.col("props")))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups create and errors delete the post that props names."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("signup", "error"))
    op = F.when(F.col("event_type") == "signup", "create").otherwise("delete")
    return e.select(F.col("k").cast("string").alias("uri"), op.alias("operation"), "ts", "event_id", "user_id")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an index row; likes and reposts from its numbers, every seventh creation time unknown."""
    e = events(spark, sf_dir)
    created = F.when(F.col("event_id") % 7 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("k") % 48).cast("int")))
    return e.select(
        F.col("event_id").cast("string").alias("uri"), F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("cid"), F.col("user_id").alias("author_did"),
        F.col("event_type").alias("match_reason"), created.alias("created_at"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("indexed_at"),
        (F.col("k") % 11).alias("like_count"), (F.col("k") % 5).alias("repost_count"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as evaluation cases."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    own = table(spark, sf_dir, "labels").join(d, "doc_id")
    split = F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("dev")
    return own.select(
        F.col("doc_id").alias("uri"), "text", (F.col("quality") == 1).alias("expected"), F.col("source").alias("bucket"), F.col("lang").alias("signal"), split.alias("split"),
        (F.col("doc_id") % 3 == 0).alias("regression"), F.array("lang").alias("langs"), F.col("source").alias("author_did"),
    )
