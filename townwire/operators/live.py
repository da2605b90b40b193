"""The live path as one plan: gates, cascade, author history, index and engagement; and the same for gaps that are filled later.

Batch and micro-batch alike: every step is a DataFrame to DataFrame function over event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townwire.functions.times import in_window
from townwire.operators import cascade, index, priors
from townwire.operators.gates import FeedConfig, gate_reason
from townwire.operators.rules import RulePack, once


def decide_with_history(posts: DataFrame, pack: RulePack, config: FeedConfig | None = None, author: str = "author_did", ts: str = "ts", key: str = "uri", path: str | None = None, **more) -> DataFrame:
    """posts with matched, reason, strong_before and soft_prior, where each author's earlier strong matches count for their later posts.

    Whether a match is strong never depends on the prior, so the cascade runs once, for both
    answers to the prior; a scan of each author's history then picks. path: a new folder that
    the verdicts are written to, as the scan reads them twice. more: what cascade.decide takes.
    """
    config = config or FeedConfig()
    decided = cascade.decide(posts, pack, both_priors=True, **more).drop("matched")
    flagged = decided.withColumn("_townwire_strong", cascade.is_strong_reason(F.col("reason"), pack))
    if path is not None:
        flagged.write.parquet(path)
        flagged = flagged.sparkSession.read.schema(flagged.schema).parquet(path)
    known = priors.with_prior(flagged, author, ts, key, "_townwire_strong", config.prior_min_strong, config.prior_days)
    reason = F.when(F.col("soft_prior"), F.col("reason_with_prior")).otherwise(F.col("reason"))
    out = known.withColumn("reason", reason).withColumn("matched", cascade.is_keep_reason(F.col("reason"), pack))
    return out.select(*(c for c in posts.columns if c not in ("matched", "reason", "strong_before", "soft_prior")), "matched", "reason", "strong_before", "soft_prior")


def gated(posts: DataFrame, config: FeedConfig, reference: Column, archive: bool = True) -> DataFrame:
    """posts with gate: why a post goes no further, or null."""
    reply = F.col("reply_parent").isNotNull() | F.col("reply_root").isNotNull()
    # a barrier, as the alt text of nested embeds is a long expression that gates and cascade both read
    posts = once(posts.withColumnsRenamed({c: f"_townwire_{c}" for c in ("text", "alt_text")}), text=F.col("_townwire_text"), alt_text=F.col("_townwire_alt_text")).select(*posts.columns)
    return posts.withColumn("gate", gate_reason(config, is_reply=reply, created=F.col("created_at"), reference=reference, text=F.col("text"), alt=F.col("alt_text"), archive=archive))


def index_rows(posts: DataFrame, pack: RulePack, config: FeedConfig | None = None, path: str | None = None, **more) -> DataFrame:
    """The index rows of new posts: those that pass the gates and that the cascade keeps, indexed at their event time."""
    config = config or FeedConfig()
    open_ = gated(posts.filter("operation = 'create'"), config, F.col("ts")).filter("gate is null").drop("gate")
    kept = decide_with_history(open_, pack, config, path=path, **more).filter("matched")
    return kept.select("uri", "cid", "author_did", "reply_parent", "reply_root", F.col("reason").alias("match_reason"), "created_at", F.col("ts").alias("indexed_at"))


def live_index(posts: DataFrame, engagement: DataFrame, pack: RulePack, config: FeedConfig | None = None, now: Column | None = None, path: str | None = None, **more) -> DataFrame:
    """The whole index after a stretch of the stream: kept posts that no later delete removes, with their engagement, within the retention time.

    posts and engagement are what sources.commits gives. Engagement counts from a post's
    indexing on, also where the post came in the same stretch. path: a new folder that verdicts
    and index rows are written to before more is joined, so that the cascade runs once.
    """
    config = config or FeedConfig()
    rows = index_rows(posts, pack, config, path=f"{path}/verdicts" if path else None, **more).withColumn("operation", F.lit("create"))
    deletes = posts.filter("operation = 'delete'").select("uri", "operation", F.col("ts").alias("indexed_at"))
    folded = index.fold(rows.unionByName(deletes, allowMissingColumns=True), "indexed_at").drop("operation")
    if path is not None:
        folded.write.parquet(f"{path}/index")
        folded = folded.sparkSession.read.schema(folded.schema).parquet(f"{path}/index")
    counted = index.engagement_counts(folded, engagement)
    return index.retained(counted, now, config.retention_days) if now is not None else counted


def backfill(events: DataFrame, existing: DataFrame, pack: RulePack, config: FeedConfig | None = None, since: Column | None = None, until: Column | None = None, path: str | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """(new index rows, outcomes): posts that a gap left out go the same way, indexed at their creation.

    events: what sources.files.post_views_to_events and commits.posts give, with status. An
    outcome is bad_payload, outside (of the window), exists, a gate's or the cascade's reason
    to skip, or indexed; outcomes has one row per uri. The archive gate is left out, as all
    posts of a gap are old. path: a new folder that the gated posts and the verdicts are written
    to, as both parts of the outcomes read them. Rows that exist stay as they are, so a second run changes nothing.
    """
    config = config or FeedConfig()
    first = index.first_wins(events, "uri", "created_at", "cid")
    inside = F.lit(True) if since is None else in_window(F.col("created_at"), since, until)
    known = existing.select("uri", F.lit(True).alias("_townwire_known")).distinct()
    marked = gated(first, config, F.col("created_at"), archive=False).join(known, "uri", "left")
    early = F.coalesce(
        F.when(F.coalesce(F.col("status"), F.lit("")) != "ok", "bad_payload"), F.when(~inside, "outside"), F.when(F.col("_townwire_known"), "exists"), F.when(F.col("gate").isNotNull(), F.concat(F.lit("skipped:"), F.col("gate")))
    )
    marked = marked.withColumn("_townwire_early", early).drop("_townwire_known", "gate")
    if path is not None:
        marked.write.parquet(f"{path}/gated")
        marked = marked.sparkSession.read.schema(marked.schema).parquet(f"{path}/gated")
    stopped = marked.filter("_townwire_early is not null").select("uri", F.col("_townwire_early").alias("outcome"))
    decided = decide_with_history(marked.filter("_townwire_early is null").drop("_townwire_early").withColumn("ts", F.col("created_at")), pack, config, path=f"{path}/verdicts" if path else None, **more)
    rows = decided.filter("matched").select("uri", "cid", "author_did", "reply_parent", "reply_root", F.col("reason").alias("match_reason"), "created_at", F.col("created_at").alias("indexed_at"))
    outcome = F.when(F.col("matched"), "indexed").otherwise(F.concat(F.lit("skipped:"), "reason"))
    return rows, stopped.unionByName(decided.select("uri", outcome.alias("outcome")))
