"""Landed commit lines as a stream whose offsets are event times: a stopped run goes on after the last time it has read, and a run that is too far behind may skip to live.

Lines land as files named ``<first>-<last>.jsonl`` after the first and last time_us in them,
written whole (under another name first, then renamed). A micro-batch reads the lines with
start < time_us <= end, a task a file; files outside are not opened. Offsets are event times
and live in the query's checkpoint, so a batch that is planned again reads the same lines.
Lines must land in the order of time: a file that comes later only holds later times.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from townwire.functions.times import resume_from

#: The name under which spark.readStream knows the source.
NAME = "townwire_landed"


class LandedFile(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class LandedReader(DataSourceStreamReader):
    """Options: path; start (time_us to read after; default: all), skip_lag_s (a batch that would reach back further starts at the newest instead; default: never), max_span_s (event time of a batch at most)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.start = int(options.get("start", -1))
        lag, span = options.get("skip_lag_s"), options.get("max_span_s")
        self.skip = None if lag is None else int(float(lag) * 1_000_000)
        self.span = None if span is None else int(float(span) * 1_000_000)
        self.at: int | None = None

    def files(self) -> list[tuple[int, int, str]]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.base_name.endswith(".jsonl") and i.base_name[0].isdigit()]
        return sorted((int(a), int(b), f"{self.path}/{n}") for n in names for a, b in [n.removesuffix(".jsonl").split("-")])

    def initialOffset(self) -> dict:
        return {"time_us": self.start}

    def latestOffset(self) -> dict:
        found = self.files()
        newest = max([self.start, *(b for _, b, _ in found)])
        if self.span is not None:
            since = self.at if self.at is not None else self.start
            first = min((a for a, b, _ in found if b > since), default=newest)
            newest = min(newest, max(since, first) + self.span)
        return {"time_us": newest}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        # whether to skip only depends on the offsets, so that a batch that is planned again decides alike
        after = start["time_us"]
        if self.skip is not None and after >= 0:
            after = resume_from(after, end["time_us"], self.skip / 1_000_000)
            after = end["time_us"] if after is None else after
        self.at = end["time_us"]
        return [LandedFile(path, after, end["time_us"]) for a, b, path in self.files() if b > after and a <= end["time_us"]]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from self.held(lines, partition)
            yield from self.held([rest], partition)

    @staticmethod
    def held(lines: list[bytes], partition: LandedFile) -> Iterator[tuple]:
        for line in lines:
            try:
                time_us = json.loads(line)["time_us"]
            except (ValueError, TypeError, KeyError):
                continue  # no commit
            if isinstance(time_us, int) and partition.after < time_us <= partition.upto:
                yield line.decode(), time_us


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, time_us long"

    def streamReader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def read_landed(spark: SparkSession, path: str, **options):
    """The stream of landed lines below path, a URI that all executors reach: value and time_us. options as for LandedReader."""
    spark.dataSource.register(Landed)
    return spark.readStream.format(NAME).options(path=path, **{k: str(v) for k, v in options.items()}).load()
