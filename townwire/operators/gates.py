"""Gates before the cascade: replies, archived posts, muted words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townwire.functions.times import is_archived


@dataclass(frozen=True)
class FeedConfig:
    """Settings that change results."""

    ignore_replies: bool = True
    ignore_archived: bool = True
    muted: tuple[str, ...] = ()
    archive_days: int = 1
    retention_days: int = 7
    prior_min_strong: int = 3
    prior_days: int = 30
    ranking: str = "indexed"


def is_muted(text: Column, alt: Column, words: tuple[str, ...]) -> Column:
    """Any muted word as a substring of text or alt text, case aside."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(alt, F.lit(""))))
    return reduce(lambda a, b: a | b, (F.contains(whole, F.lit(w.lower())) for w in words if w), F.lit(False))


def gate_reason(config: FeedConfig, *, is_reply: Column, created: Column, reference: Column, text: Column, alt: Column, archive: bool = True) -> Column:
    """Why a post goes no further, or null. Cheap tests come first; audits leave the archive gate out."""
    rules = []
    if config.ignore_replies:
        rules.append(F.when(is_reply, "reply_ignored"))
    if config.ignore_archived and archive:
        rules.append(F.when(is_archived(created, reference, config.archive_days), "archived"))
    if config.muted:
        rules.append(F.when(is_muted(text, alt, config.muted), "muted"))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def passed(posts: DataFrame, reason: Column) -> DataFrame:
    return posts.filter(reason.isNull())
