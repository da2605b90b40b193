"""The landed source resumes after what it has read, and skips to live where it is told to."""

import json
import time

from townwire.sources import commits as cm
from townwire.sources.landed import LandedReader, read_landed

S = 1_000_000


def land(folder, times, **more):
    folder.mkdir(exist_ok=True)
    body = "\n".join(json.dumps({"kind": "commit", "did": "d", "time_us": t, "commit": {"collection": cm.POST, "rkey": str(t), "operation": "create", "record": {"text": "x"}}} | more) for t in times)
    (folder / f"{times[0]}-{times[-1]}.jsonl").write_text(body + "\nnot json\n[1]\n")


def run(spark, tmp_path, out, **options):
    stream = read_landed(spark, f"file://{tmp_path}/in", **options)
    query = stream.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/{out}/batch={k}")).option("checkpointLocation", f"{tmp_path}/ck-{out}").start()
    until = time.time() + 60
    while time.time() < until and query.exception() is None and not (query.lastProgress and query.status["message"] == "Waiting for data to arrive"):
        time.sleep(0.2)
    query.stop()
    return sorted(r["time_us"] for r in spark.read.parquet(f"{tmp_path}/{out}").collect())


def test_a_stopped_run_goes_on_without_gap_or_repeat(spark, tmp_path):
    land(tmp_path / "in", [1 * S, 2 * S, 3 * S])
    land(tmp_path / "in", [4 * S, 5 * S])
    assert run(spark, tmp_path, "all") == [1 * S, 2 * S, 3 * S, 4 * S, 5 * S]
    land(tmp_path / "in", [6 * S, 5_000 * S])
    assert run(spark, tmp_path, "all") == [1 * S, 2 * S, 3 * S, 4 * S, 5 * S, 6 * S, 5_000 * S]
    rows = cm.posts(cm.decode(cm.parsed(spark.read.parquet(f"{tmp_path}/all"))))
    assert rows.count() == 7


def times_of(reader, start, end):
    return sorted(t for p in reader.partitions({"time_us": start}, {"time_us": end}) for _, t in reader.read(p))


def test_a_run_that_lags_too_far_starts_at_the_newest(tmp_path):
    for times in ([1 * S, 2 * S], [3 * S, 902 * S], [903 * S, 1_803 * S], [1_804 * S]):
        land(tmp_path / "in", times)
    reader = LandedReader({"path": f"file://{tmp_path}/in", "skip_lag_s": "900"})
    assert times_of(reader, -1, 2 * S) == [1 * S, 2 * S]
    assert times_of(reader, 2 * S, 902 * S) == [3 * S, 902 * S]  # exactly 900 s behind
    assert times_of(reader, 902 * S, 1_803 * S) == []  # 901 s: skipped, on a second planning too
    assert times_of(LandedReader(reader_options(reader)), 902 * S, 1_803 * S) == []
    assert times_of(reader, 1_803 * S, 1_804 * S) == [1_804 * S]


def reader_options(reader):
    return {"path": reader.path, "skip_lag_s": "900"}


def test_batches_of_a_span(tmp_path):
    for times in ([1 * S, 2 * S, 3 * S], [4 * S, 5 * S], [6 * S, 5_000 * S]):
        land(tmp_path / "in", times)
    reader, at, seen = LandedReader({"path": f"file://{tmp_path}/in", "start": str(2 * S), "max_span_s": "2"}), 2 * S, []
    while (end := reader.latestOffset()["time_us"]) > at:
        seen.append(times_of(reader, at, end))
        at = end
    assert [t for b in seen for t in b] == [3 * S, 4 * S, 5 * S, 6 * S, 5_000 * S] and seen[0] == [3 * S, 4 * S]


def test_only_files_in_the_span_are_opened(tmp_path):
    for times in ([1, 5], [6, 9], [10, 20]):
        land(tmp_path / "in", times)
    reader = LandedReader({"path": f"file://{tmp_path}/in"})
    assert reader.latestOffset() == {"time_us": 20}
    assert [p.path.rsplit("/", 1)[1] for p in reader.partitions({"time_us": 5}, {"time_us": 9})] == ["6-9.jsonl"]
    assert LandedReader({"path": f"file://{tmp_path}/none"}).latestOffset() == {"time_us": -1}
