"""Two Bloom filters of bounded size, for hashes seen once and seen twice, built without gathering the hashes anywhere.

The filters are cut into shards by a hash's top bits. Tasks send each hash to its shard, at
most twice per task; a shard notes it in its first filter and, if all its bits were set
there, in its second. Only the second filters are returned: a bounded number of bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from townwire.llm.common import map_slices

#: Least and most bits of each of the two filters (2^30: 128 MB), bits for each hash between them, and probes per hash.
LEAST_BITS, MOST_BITS, BITS_PER_HASH, PROBES = 1 << 23, 1 << 30, 12, 2
#: Bits of one shard, so that there are more shards, and tasks that build them, for more hashes.
SHARD_BITS = 1 << 20
#: Hashes that a task gathers before it sends them on.
FLUSH = 500_000


def bits_for(n_hashes: int) -> int:
    """A power of two. Beyond MOST_BITS the filters fill up, which lets more hashes through but never fewer."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, BITS_PER_HASH * n_hashes) - 1).bit_length()))


def shards_for(bits: int) -> int:
    return max(1, bits // SHARD_BITS)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a shard of so many bits."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(26)) & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return ((low[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * high[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) % shards


def twice_filters(rows: DataFrame, hashes_of: Callable[[dict], Iterable[np.ndarray]], bits: int = LEAST_BITS) -> list[bytes | None]:
    """The second filter by shard, as packed bits. hashes_of gives arrays of hashes for a slice of rows."""
    shards = shards_for(bits)

    def send(slices) -> Iterator[dict]:
        def flush(found: list[np.ndarray]) -> Iterator[dict]:
            values, n = np.unique(np.concatenate(found), return_counts=True)
            shard = shard_of(values, shards)
            order = np.argsort(shard, kind="stable")
            values, n, shard = values[order], n[order], shard[order]
            at = np.searchsorted(shard, np.arange(shards + 1))
            own = [i for i in range(shards) if at[i] < at[i + 1]]
            yield {"shard": own, "once": [values[at[i] : at[i + 1]].tobytes() for i in own], "twice": [values[at[i] : at[i + 1]][n[at[i] : at[i + 1]] > 1].tobytes() for i in own]}

        found: list[np.ndarray] = []
        for x in slices:
            found += hashes_of(x)
            if sum(map(len, found)) >= FLUSH:
                yield from flush(found)
                found = []
        if found:
            yield from flush(found)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bits // shards
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a = once.setdefault(row["shard"], np.zeros(size, bool))
                b = twice.setdefault(row["shard"], np.zeros(size, bool))
                at = probes(np.frombuffer(row["once"], np.uint64), size)
                b[at[:, a[at].all(axis=0)].ravel()] = True
                a[at.ravel()] = True
                b[probes(np.frombuffer(row["twice"], np.uint64), size).ravel()] = True
        if twice:
            yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([np.packbits(x).tobytes() for x in twice.values()], pa.binary())], names=["shard", "filter"])

    built = map_slices(rows, send, "shard int, once binary, twice binary").repartition(shards, "shard").mapInArrow(build, "shard int, filter binary")
    out: list[bytes | None] = [None] * shards
    for row in built.collect():  # at most `bits` bits
        out[row["shard"]] = row["filter"]
    return out


class Twice:
    """Tests hashes against the second filters."""

    def __init__(self, filters: list[bytes | None], bits: int = LEAST_BITS):
        self.filters = [None if f is None else np.frombuffer(f, np.uint8) for f in filters]
        self.size = bits // len(filters)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        shard, at, hit = shard_of(hashes, len(self.filters)), probes(hashes, self.size), np.zeros(len(hashes), bool)
        for s in np.unique(shard):
            if self.filters[s] is not None:
                i = np.flatnonzero(shard == s)
                p = at[:, i]
                hit[i] = (self.filters[s][p >> 3] >> (7 - (p & 7)) & 1).all(axis=0)
        return hit
