"""Timestamps: parsing, event time, gates and lag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTHY_LAG_S, SHED_LAG_S, SKIP_LAG_S = 300, 120, 900


def parse_iso(c: Column) -> Column:
    """ISO 8601 with Z or an offset, as a UTC timestamp; anything else is null."""
    return F.try_to_timestamp(F.trim(c))


def event_time(micros: Column) -> Column:
    """Microseconds since 1970; null where not positive."""
    return F.when(micros > 0, F.timestamp_micros(micros.cast("long")))


def is_archived(created: Column, reference: Column, days: int = 1) -> Column:
    """Created more than so many days before the reference; an unknown creation time isn't archived."""
    return F.coalesce(F.coalesce(reference, F.current_timestamp()) - created > F.expr(f"INTERVAL {days} DAY"), F.lit(False))


def in_window(ts: Column, since, until) -> Column:
    """Inclusive on both sides; null is outside."""
    return F.coalesce(ts.between(since, until), F.lit(False))


def lag_seconds(cursor_micros: Column, now_micros: Column) -> Column:
    """Seconds behind, at least 0; null without a cursor."""
    behind = (now_micros - cursor_micros) / F.lit(1e6)
    return F.when(behind.isNotNull(), F.greatest(F.lit(0.0), behind))


def resume_from(cursor: int | None, now: int, skip_after_s: int = SKIP_LAG_S) -> int | None:
    """The cursor to resume a stream from: none (live) where it lags too far behind."""
    if cursor is None or now - cursor > skip_after_s * 1_000_000:
        return None
    return cursor
