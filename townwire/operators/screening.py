"""Author screening: activity, prefix diversity, flags and a recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.functions.text import pattern, strip

HIGH_PER_DAY, ELEVATED_PER_DAY, LEAST_DIVERSITY, LEAST_SAMPLE, PREFIX = 20.0, 8.0, 0.45, 8, 40


def activity(posts: DataFrame, author: str, ts: str, text: str, as_of: Column, is_reply: Column | None = None, key: str | None = None, first: int = 5) -> DataFrame:
    """Per author: sample size, posts and daily rates of 7 and 30 days, prefix diversity, and the newest few texts.

    Diversity and texts only look at originals: posts that aren't replies and whose text isn't
    blank. key breaks ties between posts of one time. The texts are picked by a window that
    Spark limits before the shuffle, so no author's posts are gathered.
    """
    bare = strip(F.coalesce(F.col(text), F.lit("")))
    original = (bare != "") & ~(F.coalesce(is_reply, F.lit(False)) if is_reply is not None else F.lit(False))
    age = as_of - F.col(ts)
    recent = lambda d: F.count_if(age <= F.expr(f"INTERVAL {d} DAY"))
    prefix = F.when(original, F.lower(F.substring(bare, 1, PREFIX)))
    out = posts.groupBy(author).agg(F.count("*").alias("sample_n"), recent(7).alias("recent_7d"), recent(30).alias("recent_30d"), F.count_if(original).alias("originals"), F.count_distinct(prefix).alias("prefixes"))
    out = out.withColumns({"ppd_7d": F.round(F.col("recent_7d") / 7, 2), "ppd_30d": F.round(F.col("recent_30d") / 30, 2), "unique_prefix_ratio": F.round(F.col("prefixes") / F.greatest("originals", F.lit(1)), 2)})
    order = W.partitionBy(author).orderBy(F.desc(ts), *([F.desc(key)] if key else []), text)
    newest = posts.filter(original).select(author, F.col(text).alias("t"), F.row_number().over(order).alias("rn")).filter(F.col("rn") <= first)
    texts = newest.groupBy(author).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]).alias("sample_texts"))  # at most `first`
    out = out.join(texts, author, "left").withColumn("sample_texts", F.coalesce("sample_texts", F.array().cast("array<string>")))
    return out.drop("prefixes", "originals")


#: Precision of the distinct sketches: 2^14 registers, a relative error of about 0.8 %, and exact for small numbers.
SKETCH_K = 14


def sliding(posts: DataFrame, author: str, ts: str, text: str, is_reply: Column | None = None, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per author and day with posts: posts, originals and distinct prefixes of the last so many days, that day included.

    Posts shrink to one row per author and day before anything else, with a mergeable sketch of
    the prefixes; windows then merge these rows, so every day's report takes one pass. Numbers of
    posts are exact, of prefixes as good as the sketch.
    """
    bare = strip(F.coalesce(F.col(text), F.lit("")))
    original = (bare != "") & ~(F.coalesce(is_reply, F.lit(False)) if is_reply is not None else F.lit(False))
    prefix = F.when(original, F.lower(F.substring(bare, 1, PREFIX)))
    daily = posts.groupBy(author, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.count_if(original).alias("own"), F.hll_sketch_agg(prefix, SKETCH_K).alias("sketch"))
    order = W.partitionBy(author).orderBy(F.unix_date("day"))
    out = {}
    for d in days:
        last = order.rangeBetween(1 - d, 0)
        out |= {f"posts_{d}d": F.sum("n").over(last), f"originals_{d}d": F.sum("own").over(last), f"prefixes_{d}d": F.hll_sketch_estimate(F.hll_union_agg("sketch", False).over(last))}
    return daily.withColumns(out).drop("n", "own", "sketch")


def pattern_hits(screened: DataFrame, patterns: dict[str, tuple[str, ...]], description: str | None = None) -> DataFrame:
    """screened with slop_hits: names of the term patterns that any of the sample's texts, or the profile's description, holds."""
    whole = F.concat_ws("\n", "sample_texts", *([F.coalesce(F.col(description), F.lit(""))] if description else []))
    return screened.withColumn("slop_hits", F.array_compact(F.array(*(F.when(whole.rlike(pattern(terms)), F.lit(name)) for name, terms in patterns.items()))))


def is_bot(terms: tuple[str, ...], *profile: str) -> Column:
    """Does a profile's handle, name or description hold a term that bots use?"""
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in profile)).rlike(pattern(terms))


def with_flags(screened: DataFrame, bot: Column | None = None, failed: Column | None = None) -> DataFrame:
    """flags from activity and hits, worst first. The rate that counts is the higher of 7 and 30 days. An author whose profile or feed couldn't be fetched (failed) has fetch_error alone."""
    slop = F.transform(F.coalesce("slop_hits", F.array().cast("array<string>")), lambda x: F.concat(F.lit("slop:"), x)) if "slop_hits" in screened.columns else F.array().cast("array<string>")
    rate = F.greatest("ppd_7d", "ppd_30d")
    own = F.array_compact(F.array(
        F.when(bot if bot is not None else F.lit(False), "bot"),
        F.when(rate >= HIGH_PER_DAY, "high_volume").when(rate >= ELEVATED_PER_DAY, "elevated_volume"),
        F.when((F.col("unique_prefix_ratio") < LEAST_DIVERSITY) & (F.col("sample_n") >= LEAST_SAMPLE), "low_diversity"),
        F.when(F.col("sample_n") == 0, "empty"),
    ))
    flags = F.concat(own, slop)
    if failed is not None:
        flags = F.when(failed, F.array(F.lit("fetch_error"))).otherwise(flags)
    return screened.withColumn("flags", flags)


def with_recommendation(flagged: DataFrame) -> DataFrame:
    """reject, review, skip_empty or likely_ok, by the worst flag."""
    has = lambda *names: F.exists("flags", lambda f: f.isin(*names))
    slop = F.exists("flags", lambda f: f.startswith("slop:"))
    return flagged.withColumn("recommendation", F.when(has("bot", "high_volume", "fetch_error"), "reject").when(slop | has("low_diversity", "elevated_volume"), "review").when(has("empty"), "skip_empty").otherwise("likely_ok"))
