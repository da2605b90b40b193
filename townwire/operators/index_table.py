"""The post index as a partitioned table: Parquet files by the day of indexing, without a table format.

Inserts append files to their days, changes rewrite the days that they touch (dynamic
partition overwrite), retention drops whole days, and reads prune days. Columns that came
later read as their defaults in files that lack them.

Engagement reaches the index through deltas: each micro-batch writes its counts into a folder
of its own, and a merge adds to a row the batches that it hasn't counted yet, by the batch
number in the row itself. So neither a batch nor a merge that is run again counts twice.

One writer at a time; readers see a day before or after a change.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townwire.operators.index import RETENTION_DAYS, first_wins, with_columns_of

DAY = "indexed_on"
#: Columns that rows may lack, with their defaults. counted_to is the last engagement batch that the counts hold.
LATER = {"like_count": (T.LongType(), 0), "repost_count": (T.LongType(), 0), "match_reason": (T.StringType(), None), "counted_to": (T.LongType(), -1)}


@dataclass(frozen=True)
class IndexTable:
    """An index below path, a shared folder. columns: what else rows hold beside uri and indexed_at; later: columns with defaults."""

    spark: SparkSession
    path: str
    columns: dict[str, T.DataType] = field(default_factory=dict)
    later: dict[str, tuple[T.DataType, object]] = field(default_factory=lambda: dict(LATER))
    time: T.DataType = field(default_factory=T.TimestampType)

    @property
    def schema(self) -> T.StructType:
        rest = {**self.columns, **{c: kind for c, (kind, _) in self.later.items()}}
        return T.StructType([T.StructField("uri", T.StringType()), T.StructField("indexed_at", self.time), *(T.StructField(c, kind) for c, kind in rest.items()), T.StructField(DAY, T.DateType())])

    def read(self, since: Column | str | None = None, until: Column | str | None = None) -> DataFrame:
        """The rows of these days (whole days by date, both ends inclusive); only their files are listed and read. Files with fewer columns give the defaults."""
        df = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path) if self._exists(self.path) else self.spark.createDataFrame([], self.schema)
        for bound, holds in ((since, F.col(DAY) >= since), (until, F.col(DAY) <= until)):
            df = df if bound is None else df.filter(holds)
        return with_columns_of(df, {c: F.lit(default).cast(kind) for c, (kind, default) in self.later.items()}).select(*self.schema.names)

    def insert(self, rows: DataFrame) -> None:
        """Insert or ignore: rows whose uri isn't there yet, the earliest of each. A batch that is run again adds nothing."""
        have = rows.columns
        made = rows.select("uri", "indexed_at", *((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in self.columns.items()), *((F.col(c) if c in have else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in self.later.items()))
        fresh = first_wins(made.filter(F.col("uri").isNotNull() & F.col("indexed_at").isNotNull()).join(self.read().select("uri"), "uri", "left_anti"), "uri", "indexed_at")
        self._write(fresh.withColumn(DAY, F.to_date("indexed_at")), "append")

    def remove(self, uris: DataFrame) -> None:
        """Rows of these uris go. Only the days that hold one are rewritten."""
        self._rewrite(uris.select("uri").distinct(), lambda rows: rows.filter(F.col("_townwire_hit").isNull()))

    def merge_counts(self, deltas: DataFrame, upto: int, kinds: Iterable[str] = ("like", "repost")) -> None:
        """Add the deltas (kind, subject_uri, ts, n, batch) up to a batch to the rows that they are about, from the row's indexing on. Only days with such rows are rewritten."""
        kinds = list(kinds)
        rows = self.read().select("uri", "indexed_at", "counted_to")
        new = deltas.filter(F.col("batch") <= upto).join(rows, F.col("subject_uri") == F.col("uri")).filter((F.col("batch") > F.col("counted_to")) & (F.col("ts") >= F.col("indexed_at")))
        sums = new.groupBy("uri").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"_townwire_{k}") for k in kinds))

        def counted(rows: DataFrame) -> DataFrame:
            more = {f"{k}_count": F.col(f"{k}_count") + F.coalesce(F.col(f"_townwire_{k}"), F.lit(0)) for k in kinds}
            return rows.withColumns(more | {"counted_to": F.when(F.col("_townwire_hit").isNotNull(), F.lit(upto)).otherwise(F.col("counted_to")).cast("long")})

        self._rewrite(sums, counted)

    def retain(self, now, days: int = RETENTION_DAYS) -> list[str]:
        """Drop rows indexed more than so many days before now (a datetime): whole days as folders; only the day of the cut is rewritten. Returns the dropped days."""
        from datetime import timedelta

        cut = now - timedelta(days=days)
        dropped = [d for d in self.days() if d < cut.date().isoformat()]
        for day in dropped:
            self._delete(f"{self.path}/{DAY}={day}")
        edge = F.lit(cut.date().isoformat()).cast("date")
        old = self.read(edge, edge).filter(F.col("indexed_at") < F.lit(cut.isoformat()).cast(self.time))
        if not old.isEmpty():
            self.remove(old)
        return dropped

    def days(self) -> list[str]:
        """The days that the table has, from its folders' names."""
        if not self._exists(self.path):
            return []
        path, fs = self._fs(self.path)
        return sorted(s.getPath().getName().removeprefix(f"{DAY}=") for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{DAY}="))

    def _rewrite(self, hits: DataFrame, change) -> None:
        """Rewrite the days that hold a hit (uri and more): change gets their rows, joined with the hits where _townwire_hit isn't null."""
        staged = f"{self.path}.staged-{uuid.uuid4().hex}"
        found = self.read().select("uri", DAY).join(hits, "uri")
        found.write.parquet(f"{staged}/hits")
        found = self.spark.read.parquet(f"{staged}/hits")
        touched = [r[0] for r in found.select(DAY).distinct().collect()]  # as many as there are days
        if touched:
            marked = found.drop(DAY).withColumn("_townwire_hit", F.lit(True))
            rows = self.read().filter(F.col(DAY).isin(touched)).join(marked, "uri", "left")
            change(rows).select(*self.schema.names).write.partitionBy(DAY).parquet(f"{staged}/days")
            whole = self.spark.read.schema(self.schema).option("basePath", f"{staged}/days").parquet(f"{staged}/days") if any(self._fs(f"{staged}/days")[1].listStatus(self._fs(f"{staged}/days")[0])) else None
            kept = set() if whole is None else {r[0] for r in whole.select(DAY).distinct().collect()}
            if kept:
                self._write(whole, "overwrite")
            for day in touched:
                if day not in kept:  # all of its rows went
                    self._delete(f"{self.path}/{DAY}={day.isoformat()}")
        self._delete(staged)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # rows of a day meet in a few files; a day with very many is split by uri
        dealt = rows.repartition(DAY, F.pmod(F.xxhash64("uri"), F.lit(16))).sortWithinPartitions(DAY, "uri")
        dealt.select(*self.schema.names).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _delete(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)


def write_deltas(engagement: DataFrame, path: str, batch: int) -> None:
    """One micro-batch's engagement (kind, subject_uri, ts) as counts per post and time, in a folder of its own: the batch run again replaces it."""
    counts = engagement.groupBy("kind", "subject_uri", "ts").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")


DELTAS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("subject_uri", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])


def read_deltas(spark: SparkSession, path: str, since: int = -1) -> DataFrame:
    """The deltas of batches after since."""
    return spark.read.schema(DELTAS).option("basePath", path).parquet(path).filter(F.col("batch") > since)


def engagement_deltas(stream: DataFrame, path: str, checkpoint: str):
    """A streaming writer of deltas."""
    return stream.writeStream.foreachBatch(lambda batch, k: write_deltas(batch, path, k)).option("checkpointLocation", checkpoint)
