"""Rankings of the index and gap-free keyset pages.

A page key carries every sort key at full precision plus the uri, so rows with equal keys
are neither skipped nor repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.operators.gates import FeedConfig

MIN_PAGE, MAX_PAGE, DEFAULT_PAGE = 1, 100, 20
END = "eof"


def engagement_score(likes: Column, reposts: Column) -> Column:
    return F.coalesce(likes, F.lit(0)) + 2 * F.coalesce(reposts, F.lit(0))


@dataclass(frozen=True)
class Ranking:
    """Sort keys as numbers, all descending; null is behind every value."""

    name: str
    keys: tuple[tuple[str, Column], ...]

    def keyed(self, index: DataFrame) -> DataFrame:
        return index.withColumns({k: F.coalesce(c.cast("long"), F.lit(-(1 << 62))) for k, c in self.keys})

    def order(self) -> list[Column]:
        return [*(F.desc(k) for k, _ in self.keys), F.desc("cid"), F.desc("uri")]

    def page(self, index: DataFrame, cursor: str | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
        """Up to limit rows behind the cursor, with the cursor that continues after each row."""
        if cursor == END:
            return self.page(index.filter("false"), None, limit)
        df = self.keyed(index)
        names = [*(k for k, _ in self.keys), "cid", "uri"]
        df = df.withColumn("next_cursor", F.concat_ws("::", *(F.col(k).cast("string") for k, _ in self.keys), F.hex(F.col("cid")), F.hex(F.col("uri"))))
        if cursor is not None:
            df = df.filter(_behind(names, self.parse(cursor)))
        return df.orderBy(*self.order()).limit(clamp(limit)).drop(*(k for k, _ in self.keys))

    def parse(self, cursor: str) -> list:
        """The key of a cursor; a malformed one is an error."""
        parts = cursor.split("::")
        if len(parts) != len(self.keys) + 2:
            raise ValueError(f"malformed cursor {cursor!r} for ranking {self.name}")
        try:
            return [*(int(p) for p in parts[:-2]), *(bytes.fromhex(p).decode() for p in parts[-2:])]
        except ValueError as e:
            raise ValueError(f"malformed cursor {cursor!r} for ranking {self.name}") from e


def _behind(names: list[str], key: list) -> Column:
    """Row-value comparison (names) < (key), spelled out."""
    terms = [reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(names[:i], key[:i])], F.col(names[i]) < key[i]) for i in range(len(names))]
    return reduce(lambda a, b: a | b, terms)


def clamp(limit: int | None) -> int:
    return max(MIN_PAGE, min(MAX_PAGE, DEFAULT_PAGE if limit is None else int(limit)))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def rankings() -> dict[str, Ranking]:
    """The modes by name. Built on call, as columns need a running session."""
    indexed = ("k_indexed", _micros("indexed_at"))
    return {
        "indexed": Ranking("indexed", (indexed,)),
        "created": Ranking("created", (("k_created", _micros("created_at")), indexed)),
        "engagement": Ranking("engagement", (("k_score", engagement_score(F.col("like_count"), F.col("repost_count"))), indexed)),
    }


def page_of(index: DataFrame, config: FeedConfig, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """A page of the ranking that the settings name."""
    modes = rankings()
    if config.ranking not in modes:
        raise ValueError(f"unknown ranking {config.ranking!r}, not one of {sorted(modes)}")
    return modes[config.ranking].page(index, cursor, limit)


def page_numbers(index: DataFrame, ranking: Ranking, per_page: int) -> DataFrame:
    """Every row's page, from 0: counted in two steps over ranges of all sort keys, so no task sorts the whole index, nor all rows of one leading key.

    The ranges are made once: both steps read one shuffle.
    """
    df = ranking.keyed(index)
    parts = df.repartitionByRange(*ranking.order()).withColumn("_townwire_part", F.spark_partition_id())
    sizes = parts.groupBy("_townwire_part").agg(F.count("*").alias("_townwire_n"))
    before = F.coalesce(F.sum("_townwire_n").over(W.orderBy("_townwire_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_townwire_part", before.alias("_townwire_before"))  # one row per partition
    rank = F.row_number().over(W.partitionBy("_townwire_part").orderBy(*ranking.order()))
    numbered = parts.withColumn("_townwire_rank", rank).join(F.broadcast(starts), "_townwire_part")
    position = F.col("_townwire_before") + F.col("_townwire_rank") - 1
    out = numbered.withColumn("position", position.cast("long")).withColumn("page", F.floor(position / per_page).cast("long"))
    return out.drop("_townwire_part", "_townwire_rank", "_townwire_before", *(k for k, _ in ranking.keys))
