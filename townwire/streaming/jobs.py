"""Streaming jobs: the batch transforms over readStream, with keyed state only for author history.

Late data: the watermark bounds state; the archive gate is relative to event time, so a
replay decides alike. Offsets live in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from townwire.functions.times import HEALTHY_LAG_S, lag_seconds
from townwire.operators.index import fold


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def deduplicated(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark: duplicate-safe inserts."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def clusters(times: np.ndarray, gap: int) -> list[list[int]]:
    """[first, last, number] of the runs of times (microseconds) whose neighbours are a gap apart at most."""
    times = np.sort(times)
    cuts = [0, *(np.flatnonzero(np.diff(times) > gap) + 1), len(times)]
    return [[int(times[a]), int(times[b - 1]), b - a] for a, b in zip(cuts, cuts[1:]) if b > a]


def merged(found: list[list[int]], gap: int) -> list[list[int]]:
    """Clusters of several batches as one list, in time order. Exact, as times between two clusters' ends are near both."""
    out: list[list[int]] = []
    for first, last, n in sorted(found):
        if out and first - out[-1][1] <= gap:
            out[-1] = [out[-1][0], max(out[-1][1], last), out[-1][2] + n]
        else:
            out.append([first, last, n])
    return out


def author_counters(strong: DataFrame, author: str, ts: str, days: float, delay: str) -> DataFrame:
    """After every micro-batch, per author with new strong matches: the counter since the last gap.

    State is (count, first and last time) per author and goes after the gap has passed by the
    watermark. Rows of a batch may come in any order: each Arrow batch shrinks to its clusters,
    of which there are no more than gaps, so an author with very many rows takes no memory.
    """
    gap = int(days * 86_400_000_000)

    def advance(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, first, last = state.get if state.exists else (0, 0, 0)
        found = [[first, last, count]] if count else []
        for rows in batches:
            found = merged(found + clusters(rows[ts].to_numpy("datetime64[us]").astype(np.int64), gap), gap)
        first, last, count = found[-1]
        state.update((count, first, last))
        state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({author: [who[0]], "strong_match_count": [count], "last_strong_at": [pd.Timestamp(last, unit="us")]})

    kind = strong.schema[author].dataType.simpleString()
    return (
        strong.select(author, ts).withWatermark(ts, delay).groupBy(author)
        .applyInPandasWithState(advance, f"{author} {kind}, strong_match_count long, last_strong_at timestamp", "count long, first_us long, last_us long", "update", GroupStateTimeout.EventTimeTimeout)
    )


#: The state store on disk that author_runs needs: state larger than memory, checkpointed by its changes.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RUN = T.StructType([T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("n", T.LongType())])


class AuthorRuns(StatefulProcessor):
    """Keeps an author's runs of strong matches that rows to come may still join, as a list.

    A late row may lie before the newest run, extend an older one or bridge two; only the newest
    counts, but it may yet grow backwards. A run that ended more than a gap before the watermark
    is out of reach and goes by an event-time timer, or, in wall-clock time, by the list's TTL.
    """

    def __init__(self, author: str, ts: str, gap_us: int, ttl_ms: int | None = None):
        self.author, self.ts, self.gap, self.ttl = author, ts, gap_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", RUN, self.ttl) if self.ttl else handle.getListState("runs", RUN)

    def _keep(self, runs: list[list[int]], now_ms: int) -> None:
        """Stores the runs in reach of the watermark, and a timer for when the first of them leaves it."""
        if not self.ttl:
            runs = [r for r in runs if self._ends(r) > now_ms]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if runs:
                self.handle.registerTimer(self._ends(runs[0]))
        if runs:
            self.runs.put([tuple(int(x) for x in r) for r in runs])
        else:
            self.runs.clear()

    def _ends(self, run: list[int]) -> int:
        return (run[1] + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        runs = [list(r) for r in self.runs.get()] if self.runs.exists() else []
        for batch in rows:
            times = batch[self.ts].dropna()
            runs = merged(runs + clusters(times.to_numpy("datetime64[us]").astype(np.int64), self.gap), self.gap)
        if not runs:  # rows without a time only
            return
        _, last, n = runs[-1]
        self._keep(runs, 0 if self.ttl else timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.author: [key[0]], "strong_match_count": [n], "last_strong_at": [pd.Timestamp(last, unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.runs.exists():
            self._keep([list(r) for r in self.runs.get()], expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def author_runs(strong: DataFrame, author: str, ts: str, days: float, delay: str, ttl_ms: int | None = None) -> DataFrame:
    """author_counters for rows that come late, across micro-batches in any order within delay: per author with new strong matches the counter of the newest run.

    State is a list of (first, last, count) per author in the RocksDB store (the session's
    ``ROCKSDB`` setting), to be read back with ``runs_of``. ttl_ms: state goes so long after an
    author's last write in wall-clock time, and no row is too late; else it goes by event
    time, and rows behind the watermark are dropped, so that replays decide alike. Wall-clock
    queries make batches without data for ever, so one that is to end with its input needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    kind = strong.schema[author].dataType.simpleString()
    processor = AuthorRuns(author, ts, int(days * 86_400_000_000), ttl_ms)
    return (
        strong.select(author, ts).withWatermark(ts, delay).groupBy(author)
        .transformWithStateInPandas(processor, f"{author} {kind}, strong_match_count long, last_strong_at timestamp", "update", "ProcessingTime" if ttl_ms else "EventTime")
    )


def runs_of(spark: SparkSession, checkpoint: str, author: str) -> DataFrame:
    """What author_runs keeps at its last batch: author, first_at, last_at, n of each run in reach."""
    state = spark.read.format("statestore").option("stateVarName", "runs").load(checkpoint)
    at = lambda name: F.timestamp_micros(F.col(f"list_element.{name}"))
    return state.select(F.col(f"key.{author}").alias(author), at("first_us").alias("first_at"), at("last_us").alias("last_at"), F.col("list_element.n").alias("n"))


def engagement_on_posts(posts: DataFrame, engagement: DataFrame, delay: str, horizon: str) -> DataFrame:
    """Engagement joined to posts indexed before it, within a horizon that bounds both sides' state."""
    p = posts.select(F.col("uri").alias("subject_uri"), "indexed_at").withWatermark("indexed_at", delay)
    e = engagement.withWatermark("ts", delay)
    return e.join(p, (e["subject_uri"] == p["subject_uri"]) & (e["ts"] >= p["indexed_at"]) & (e["ts"] <= p["indexed_at"] + F.expr(f"INTERVAL {horizon}"))).select(e["kind"], e["subject_uri"], e["ts"])


def volume(events: DataFrame, ts: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Counts per time window and keys."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of a key: event counts between gaps."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def append_batches(df: DataFrame, path: str, checkpoint: str):
    """An idempotent append: each micro-batch overwrites a folder of its own, so a replayed batch isn't doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def compact(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """The appended log of creates and deletes folded to the rows that live: deletes are tombstones, whatever batch they came in."""
    return fold(spark.read.parquet(path), ts)


def lag_health(events: DataFrame, ts: str, now: Column, *keys: str) -> DataFrame:
    """How far the newest event, overall or of each key, is behind: lag_s, and whether that is healthy. Without events both are null."""
    newest = events.groupBy(*keys).agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("newest"))
    lag = lag_seconds(F.col("newest"), F.unix_micros(now.cast("timestamp")))
    return newest.select(*keys, lag.alias("lag_s"), (lag < HEALTHY_LAG_S).alias("healthy"))


def observed(stream: DataFrame, ts: str, name: str = "lag") -> DataFrame:
    """The stream with its newest event time and number of rows as metrics of every micro-batch's progress."""
    return stream.observe(name, F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n"))


class LagTable(StreamingQueryListener):
    """Writes what observed() gives to a table, a row per micro-batch that saw events: query, batch, newest event, rows. Added with spark.streams.addListener."""

    SCHEMA = "query string, batch long, newest timestamp, n long"

    def __init__(self, spark: SparkSession, path: str, name: str = "lag"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = p.observedMetrics.get(self.name)
        if metrics is not None and metrics["newest"] is not None:
            self.spark.createDataFrame([(p.name or str(p.id), p.batchId, metrics["newest"], metrics["n"])], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def table_health(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Per query of a LagTable how far its newest event is behind, and whether that is healthy: a stalled stream writes no more rows, so its lag grows."""
    return lag_health(spark.read.schema(LagTable.SCHEMA).parquet(path), "newest", now, "query")


def run_available(df: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Everything available now, batch by batch into a folder, read back: all batches, of complete mode the last."""
    spark = df.sparkSession
    query = append_batches(df, path, checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # nothing was there to read
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch", "left_semi")  # one row
    return out.drop("batch")
