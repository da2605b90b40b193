"""Author history: strong matches make an author's later ambiguous posts count.

The counter starts anew after a gap. Whether a match is strong never depends on the prior, so
strong flags come first and the history is a prefix scan. An author's rows are cut into time
slots; windows only look at one slot of one author. Each slot then shrinks to a summary: its
first and last strong match, whether a gap lies between them, and the count since the last
gap. Summaries are combined in order, a row per slot, and what a slot finds when it begins is
carried back to its rows. So an author with any share of all rows is spread over as many
tasks as their time has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_STRONG, WINDOW_DAYS = 3, 30
#: Unit of time, as in date_trunc, of an author's rows that one window takes.
SLOT = "hour"
P = "_townwire_"


def _gap(days: float) -> Column:
    return F.expr(f"INTERVAL {int(days * 86400)} SECOND")


def _within_slots(posts: DataFrame, author: str, ts: str, key: str, strong: str, days: float, slot: str) -> DataFrame:
    """posts with what a slot alone tells of each row: the last strong match before it, matches and gaps before it, and matches up to the last gap. One exchange, one sort."""
    begin = F.coalesce(F.date_trunc(slot, ts), F.lit("0001-01-01").cast("timestamp"))  # rows without a time come first
    order = W.partitionBy(author, P + "slot").orderBy(ts, key)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    is_strong = F.coalesce(F.col(strong), F.lit(False))
    df = posts.withColumn(P + "slot", begin).withColumns({P + "last": F.last(F.when(is_strong, F.col(ts)), ignorenulls=True).over(before), P + "n": F.coalesce(F.sum(is_strong.cast("long")).over(before), F.lit(0))})
    opens = is_strong & (F.col(P + "last").isNull() | (F.col(ts) - F.col(P + "last") > _gap(days)))
    df = df.withColumn(P + "opens", opens)
    return df.withColumns({P + "runs": F.coalesce(F.sum(F.col(P + "opens").cast("long")).over(before), F.lit(0)), P + "until": F.last(F.when(F.col(P + "opens"), F.col(P + "n")), ignorenulls=True).over(before)})


def _summaries(within: DataFrame, author: str, ts: str, strong: str, days: float) -> DataFrame:
    """A row per author and slot: the counter and the last match when it begins (n_in, last_in) and when it ends (n_out, last_out)."""
    at = F.when(F.col(strong), F.col(ts))
    slots = within.groupBy(author, P + "slot").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.sum(F.col(P + "opens").cast("long")).alias("runs"),
        (F.count_if(F.col(strong)) - F.coalesce(F.max(F.when(F.col(P + "opens"), F.col(P + "n"))), F.lit(0))).alias("n"),
    )
    order = W.partitionBy(author).orderBy(P + "slot")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("last_in", F.last("last", ignorenulls=True).over(before))
    anew = F.col("first").isNotNull() & ((F.col("runs") > 1) | F.col("last_in").isNull() | (F.col("first") - F.col("last_in") > _gap(days)))
    slots = slots.withColumn("session", F.sum(anew.cast("long")).over(order))
    slots = slots.withColumn("n_out", F.sum("n").over(W.partitionBy(author, "session").orderBy(P + "slot"))).withColumn("n_in", F.coalesce(F.lag("n_out").over(order), F.lit(0)))
    return slots.select(author, P + "slot", "n_in", "last_in", "n_out", F.coalesce("last", "last_in").alias("last_out"), "first")


def with_prior(posts: DataFrame, author: str, ts: str, key: str, strong: str, min_strong: int = MIN_STRONG, days: float = WINDOW_DAYS, slot: str = SLOT) -> DataFrame:
    """posts with strong_before (the author's counter just before the row), last_strong_at and soft_prior.

    Rows without an author have no history. posts is read twice, for summaries and for rows:
    where it is costly it should be a written table. Rows are shuffled once.
    """
    named = F.coalesce(F.col(author).cast("string"), F.lit("")) != ""
    within = _within_slots(posts.filter(named), author, ts, key, strong, days, slot)
    carried = _summaries(within, author, ts, strong, days).select(F.col(author).alias(P + "author"), F.col(P + "slot").alias(P + "begins"), "n_in", "last_in", "first")
    rows = within.join(carried, (F.col(author) == F.col(P + "author")) & (F.col(P + "slot") == F.col(P + "begins")))
    own = F.col(P + "n") - F.coalesce(P + "until", F.lit(0))
    goes_on = F.coalesce(F.col("first") - F.col("last_in") <= _gap(days), F.lit(False))
    counted = F.when(F.col(P + "last").isNull(), F.col("n_in")).when((F.col(P + "runs") == 1) & goes_on, own + F.col("n_in")).otherwise(own)
    rows = rows.select(*posts.columns, F.coalesce(P + "last", "last_in").alias("last_strong_at"), counted.alias("strong_before"))
    prior = (F.col("strong_before") >= min_strong) & F.coalesce(F.col(ts) - F.col("last_strong_at") <= _gap(days), F.lit(False))
    none = posts.filter(~named).withColumns({"last_strong_at": F.lit(None).cast(posts.schema[ts].dataType), "strong_before": F.lit(0).cast("long"), "soft_prior": F.lit(False)})
    return rows.withColumn("soft_prior", prior).unionByName(none)


def author_stats(posts: DataFrame, author: str, ts: str, key: str, strong: str, days: float = WINDOW_DAYS, slot: str = SLOT) -> DataFrame:
    """Per author: strong matches since the last gap, and the time of the last one."""
    matches = posts.filter(F.col(strong)).select(author, ts, key, strong)
    slots = _summaries(_within_slots(matches, author, ts, key, strong, days, slot), author, ts, strong, days)
    return slots.groupBy(author).agg(F.max_by("n_out", P + "slot").alias("strong_match_count"), F.max("last_out").alias("last_strong_at"))


def eligible(stats: DataFrame, as_of: Column, min_strong: int = MIN_STRONG, days: float = WINDOW_DAYS) -> DataFrame:
    """Authors whose counter and last match give them the prior at a time; both bounds inclusive."""
    return stats.filter((F.col("strong_match_count") >= min_strong) & (as_of - F.col("last_strong_at") <= _gap(days)))
