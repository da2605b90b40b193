"""Batch and stream give the same rows over time-ordered files."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from townwire.operators import priors
from townwire.operators.index import first_wins
from townwire.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "k long, author string, ts timestamp, strong boolean"


def landed(spark, path):
    rows = [(i, "ab"[i * 7 % 3 % 2], T0 + timedelta(hours=5 * i if i < 30 else 5 * i + 200), i % 2 == 0) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return rows


def test_author_counters_equal_batch(spark, tmp_path):
    landed(spark, tmp_path)
    stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    out = jobs.run_available(jobs.author_counters(stream.filter("strong"), "author", "ts", 2, "1 day"), f"{tmp_path}/counters", "update", f"{tmp_path}/ck1")
    last = {r["author"]: r["strong_match_count"] for r in first_wins(out, "author", -F.unix_micros("last_strong_at")).collect()}
    batch = priors.author_stats(spark.read.parquet(f"{tmp_path}/in"), "author", "ts", "k", "strong", 2)
    assert last == {r["author"]: r["strong_match_count"] for r in batch.collect()}


def test_dedupe_append_and_compact(spark, tmp_path):
    rows = landed(spark, tmp_path)
    stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    once = jobs.deduplicated(stream.withColumn("key", F.col("k") % 10), "key", "ts", "60 days")
    query = jobs.append_batches(once, f"{tmp_path}/log", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 10
    assert len(rows) == 60


def test_compact_applies_deletes_of_later_batches(spark, tmp_path):
    log = [("a", "create", 1), ("b", "create", 1), ("a", "delete", 2), ("b", "create", 3), ("c", "delete", 1), ("c", "create", 2)]
    for k, (uri, operation, hour) in enumerate(log):
        spark.createDataFrame([(uri, operation, T0 + timedelta(hours=hour))], "uri string, operation string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/log/batch={k}")
    assert sorted((r["uri"], r["ts"]) for r in jobs.compact(spark, f"{tmp_path}/log").collect()) == [("b", T0 + timedelta(hours=1)), ("c", T0 + timedelta(hours=2))]


def test_clusters_merge_in_any_order():
    rng = np.random.default_rng(1)
    times = np.sort(rng.integers(0, 10_000, 300))
    whole = jobs.clusters(times, 40)
    for _ in range(5):
        rng.shuffle(times)
        found = []
        for part in np.array_split(times, 7):
            found = jobs.merged(found + jobs.clusters(part, 40), 40)
        assert found == whole and sum(n for _, _, n in found) == 300


def test_lag_health(spark):
    df = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(seconds=400))], "k string, ts timestamp")
    assert sorted(tuple(r) for r in jobs.lag_health(df, "ts", F.lit(T0 + timedelta(seconds=10)), "k").collect()) == [("a", 10.0, True), ("b", 410.0, False)]


def test_windows_and_engagement(spark, tmp_path):
    landed(spark, tmp_path)
    read = lambda: jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    per_day = jobs.run_available(jobs.volume(read(), "ts", "1 day", "1 hour"), f"{tmp_path}/per_day", "complete", f"{tmp_path}/ck3")
    assert per_day.agg(F.sum("n")).first()[0] == 60
    own = jobs.run_available(jobs.sessions(read(), "ts", "30 hours", "1 hour", "author"), f"{tmp_path}/own", "append", f"{tmp_path}/ck4")
    assert own.count() >= 1
    posts = read().select(F.concat(F.lit("u"), "k").alias("uri"), F.col("ts").alias("indexed_at"))
    likes = read().select(F.lit("like").alias("kind"), F.concat(F.lit("u"), F.col("k") - 1).alias("subject_uri"), "ts")
    got = jobs.run_available(jobs.engagement_on_posts(posts, likes, "1 hour", "6 HOURS"), f"{tmp_path}/likes", "append", f"{tmp_path}/ck5")
    assert got.count() == 58


def test_a_stalled_stream_becomes_unhealthy(spark, tmp_path):
    import time

    landed(spark, tmp_path)
    listener = jobs.LagTable(spark, f"{tmp_path}/lags")
    spark.streams.addListener(listener)
    try:
        stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        query = jobs.append_batches(jobs.observed(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/ck").queryName("posts").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 30
        while time.time() < until and not (tmp_path / "lags").exists():
            time.sleep(0.2)
        while time.time() < until and spark.read.parquet(f"{tmp_path}/lags").count() < 3:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = spark.read.parquet(f"{tmp_path}/lags").collect()
    newest = T0 + timedelta(hours=5 * 59 + 200)
    assert sorted(r["n"] for r in rows) == [20, 20, 20] and max(r["newest"] for r in rows) == newest and {r["query"] for r in rows} == {"posts"}
    health = lambda later: [tuple(r) for r in jobs.table_health(spark, f"{tmp_path}/lags", F.lit(newest + timedelta(seconds=later))).collect()]
    assert health(299) == [("posts", 299.0, True)] and health(300) == [("posts", 300.0, False)]


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    yield
    spark.conf.set(jobs.ROCKSDB[0], before)


def newest(df):
    """Each author's last update: the largest time, of equal ones the largest count."""
    out = {}
    for r in df.collect():
        out[r["author"]] = max(out.get(r["author"], (T0, 0)), (r["last_strong_at"], r["strong_match_count"]))
    return {a: n for a, (_, n) in out.items()}


def test_author_runs_with_late_rows_and_restart(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(5)
    hours = np.sort(rng.integers(0, 400, 90))
    rows = [(i, "abc"[int(rng.integers(3))], T0 + timedelta(hours=int(h)), True) for i, h in enumerate(hours)]
    late = [rows[i] for i in np.argsort(hours + rng.integers(0, 30, 90))]  # up to 30 hours late

    def land(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        return jobs.run_available(jobs.author_runs(stream, "author", "ts", 1, "2 days"), f"{tmp_path}/out", "update", f"{tmp_path}/ck")

    land(late[:45])
    run()
    land(late[45:70])
    run()  # from the checkpoint
    land(late[70:])
    got = newest(run())
    batch = priors.author_stats(spark.createDataFrame(rows, SCHEMA), "author", "ts", "k", "strong", 1)
    want = {r["author"]: r["strong_match_count"] for r in batch.collect()}
    assert got == want
    state = {}
    for r in jobs.runs_of(spark, f"{tmp_path}/ck", "author").collect():
        state.setdefault(r["author"], []).append((r["last_at"], r["n"]))
    assert {a: max(runs)[1] for a, runs in state.items()} == want
    assert all(len(runs) < 8 for runs in state.values())  # runs out of reach are gone


def test_author_runs_bridge_and_expire(spark, tmp_path, rocksdb):
    at = lambda h: T0 + timedelta(hours=h)
    parts = [[(1, "a", at(0), True), (2, "a", at(30), True)], [(3, "a", at(15), True), (4, "a", None, True)], [(5, "b", at(2000), True)], [(6, "b", at(2001), True)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        out = jobs.run_available(jobs.author_runs(stream, "author", "ts", 1, "2 days"), f"{tmp_path}/out", "update", f"{tmp_path}/ck")
    rows = [(r["author"], r["strong_match_count"], r["last_strong_at"]) for r in out.collect()]
    assert ("a", 1, at(30)) in rows and ("a", 3, at(30)) in rows  # the late row joins both runs
    assert [(r["author"], r["n"], r["first_at"]) for r in jobs.runs_of(spark, f"{tmp_path}/ck", "author").collect()] == [("b", 2, at(2000))]


def test_author_runs_by_ttl(spark, tmp_path, rocksdb):
    landed(spark, tmp_path)
    stream = jobs.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        out = jobs.run_available(jobs.author_runs(stream.filter("strong"), "author", "ts", 2, "1 day", ttl_ms=3_600_000), f"{tmp_path}/out", "update", f"{tmp_path}/ck")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    batch = priors.author_stats(spark.read.parquet(f"{tmp_path}/in"), "author", "ts", "k", "strong", 2)
    assert newest(out) == {r["author"]: r["strong_match_count"] for r in batch.collect()}
