"""The post index as a fold over commits: first create wins, deletes are tombstones, engagement counts, retention."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX_COLUMNS = ("uri", "cid", "author_did", "reply_parent", "reply_root", "match_reason", "created_at", "indexed_at", "like_count", "repost_count")
RETENTION_DAYS = 7


def valid_commits(commits: DataFrame) -> DataFrame:
    """Rows with a uri and an operation that acts."""
    return commits.filter((F.coalesce(F.col("uri").cast("string"), F.lit("")) != "") & F.col("operation").isin("create", "delete"))


def first_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row per key, the first in the given order. Partial before the shuffle: only ordering columns and the row travel."""
    columns = rows.columns
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_townwire_key")).agg(best.alias("row")).select("row.*").select(*columns)


def fold(commits: DataFrame, ts: str = "ts") -> DataFrame:
    """The rows that live: per uri the first create after its last delete. A delete at the create's own time removes it."""
    acting = valid_commits(commits)
    last_delete = F.max(F.when(F.col("operation") == "delete", F.col(ts))).over(W.partitionBy("uri"))
    created = acting.withColumn("_townwire_deleted", last_delete).filter((F.col("operation") == "create") & (F.col("_townwire_deleted").isNull() | (F.col(ts) > F.col("_townwire_deleted"))))
    return first_wins(created.drop("_townwire_deleted"), "uri", ts)


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "uri", *order: str) -> DataFrame:
    """Insert-or-ignore: incoming keys that exist nowhere yet, the first of each."""
    return first_wins(incoming.join(existing.select(key).distinct(), key, "left_anti"), key, *(order or (key,)))


def engagement_counts(index: DataFrame, engagement: DataFrame, kinds: Iterable[str] = ("like", "repost"), as_of: bool = True, slot: str = "hour") -> DataFrame:
    """Index rows with <kind>_count. Engagement counts from the moment a post is indexed (as_of) or at any time.

    engagement: kind, subject_uri, ts. It is summed per post and ``slot`` before any join, so
    that a post with a third of all likes is no hot key. Whole slots behind the post's own then
    count by their sums; rows are only compared one by one in the slot in which it is indexed.
    """
    kinds = list(kinds)
    of = lambda df: df.groupBy(F.col("subject_uri").alias("uri"), *([F.date_trunc(slot, "ts").alias("_townwire_slot")] if as_of else [])).agg(*(F.count_if(F.col("kind") == k).alias(f"new_{k}") for k in kinds))
    sums = lambda df: df.groupBy("uri").agg(*(F.sum(f"new_{k}").alias(f"new_{k}") for k in kinds))
    if as_of:
        posts = index.select("uri", "indexed_at")
        begins = F.date_trunc(slot, "indexed_at")
        later = of(engagement).join(posts, "uri").filter(F.col("_townwire_slot") > begins)
        # distinct times first: in one slot a post has at most as many as there are microseconds, mostly far fewer than rows
        times = engagement.groupBy("subject_uri", "kind", "ts").agg(F.count("*").alias("n"), F.first(F.date_trunc(slot, "ts")).alias("_townwire_slot"))
        same = times.join(posts.select(F.col("uri").alias("subject_uri"), "indexed_at", begins.alias("_townwire_slot")), ["subject_uri", "_townwire_slot"]).filter("ts >= indexed_at")
        own = same.groupBy(F.col("subject_uri").alias("uri")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"new_{k}") for k in kinds))
        counted = sums(later.select("uri", *(f"new_{k}" for k in kinds)).unionByName(own))
    else:
        counted = of(engagement)
    out = index.join(counted, "uri", "left")
    for k in kinds:
        had = F.coalesce(F.col(f"{k}_count"), F.lit(0)) if f"{k}_count" in index.columns else F.lit(0)
        out = out.withColumn(f"{k}_count", (had + F.coalesce(F.col(f"new_{k}"), F.lit(0))).cast("long"))
    return out.drop(*(f"new_{k}" for k in kinds))


def retained(index: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows indexed within the retention time."""
    return index.filter(F.col("indexed_at") >= now - F.expr(f"INTERVAL {days} DAY"))


def with_columns_of(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive schema change: missing columns appear with their default, nulls in them take it too."""
    return rows.select(*(c for c in rows.columns if c not in defaults), *(F.coalesce(F.col(c), d).alias(c) if c in rows.columns else d.alias(c) for c, d in defaults.items()))
