"""Audits: the rules of today over the index of yesterday, and what a purge would remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.functions.text import preview


def audit(index: DataFrame, hydrated: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per index row: its indexed reason, today's verdict and a status (kept, dropped, not_found).

    hydrated: uri, text. decided: uri, matched, reason, gates included.
    """
    own = index.select("uri", F.col("match_reason").alias("indexed_reason"))
    joined = own.join(hydrated.select("uri", "text"), "uri", "left").join(decided.select("uri", "matched", "reason"), "uri", "left")
    found = F.col("matched").isNotNull()
    return joined.select(
        "uri", "indexed_reason", preview(F.col("text")).alias("text_preview"), F.coalesce("matched", F.lit(False)).alias("matched"),
        F.when(found, F.col("reason")).otherwise("not_found").alias("reason"),
        F.when(~found, "not_found").when(F.col("matched"), "kept").otherwise("dropped").alias("status"),
    )


def purge(index: DataFrame, audited: DataFrame) -> DataFrame:
    """The index without rows that the audit drops; rows that weren't found stay."""
    return index.join(audited.filter("status = 'dropped'").select("uri"), "uri", "left_anti")


def outcome_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))
