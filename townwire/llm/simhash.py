"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints, one map. Equal fingerprints fall into one class, held by its smallest doc_id.
2. Candidates: 64 bits in five blocks; fingerprints at most three bits apart agree on two
   of them at least. Each class goes to the ten buckets of its block pairs. Buckets with
   one class end there. A bucket over ``BLOCK`` classes is dealt into chunks and every pair
   of chunks is compared in a task of its own, so no bucket is cut and none is gathered.
3. Comparison: a block's fingerprints are stored as 64 vertical bit planes. A plane updates
   64 distances per machine word in carry-save counters; rows whose distances all exceed the
   radius are abandoned. A block sends on a spanning forest of its links only.
4. Connected components over the links.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links
like any other; rows with equal doc_id are one node; a null doc_id has a fingerprint and
belongs to the component of its fingerprint's class (null if it is there alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.common import join_counted, map_slices, stored, texts
from townwire.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Classes that are compared at once.
BLOCK = 512


def fingerprint(text: str) -> int:
    """Bits set in over half the hashes of the text's word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(slices):
        for x in slices:
            yield {"doc_id": x["doc_id"], "fp": np.array([fingerprint(t) for t in x["text"]], np.uint64).view(np.int64)}

    return map_slices(texts(docs), run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes; lane j of plane b is bit b of fingerprint j."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -len(fps) % 64))), axis=1, bitorder="little")).view(np.uint64)


def close_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of fingerprints at most radius bits apart."""
    n, planes = len(fps), planes_of(fps)
    lanes = np.arange(planes.shape[1] * 64)
    rows = np.arange(n)
    over = np.ascontiguousarray(np.packbits((lanes[None, :] <= rows[:, None]) | (lanes[None, :] >= n), axis=1, bitorder="little")).view(np.uint64)
    count = [np.zeros_like(over) for _ in range(radius.bit_length())]
    queries = fps
    for b in range(64):
        carry = planes[b][None, :] ^ -((queries >> np.uint64(b)) & np.uint64(1))[:, None]
        for c in count:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            live = (over != ~np.uint64(0)).any(axis=1)
            if not live.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if not live.all():
                rows, queries, over, count = rows[live], queries[live], over[live], [c[live] for c in count]
    at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    if radius & (radius + 1):  # the counters overflow later than the radius: count the rest
        near = np.bitwise_count(fps[rows[at]] ^ fps[lane]) <= radius
        at, lane = at[near], lane[near]
    return rows[at], lane


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(classes: DataFrame, n_classes: int) -> DataFrame:
    """Edges (a, b) between classes (fp, rep), enough to connect all that are linked."""
    field = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    buckets = [(F.lit(t << 26).cast("long") + field(i) * F.lit(1 << 13) + field(j)) for t, (i, j) in enumerate(combinations(range(5), 2))]
    dealt = classes.select("fp", "rep", F.explode(F.array(*buckets)).alias("bucket"))
    sizes = stored(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    chunks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    placed = (
        join_counted(dealt, sizes, "bucket", "n", len(buckets) * n_classes).withColumn("chunks", chunks).withColumn("own", own)
        .select("fp", "rep", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("fp", "rep", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; whole blocks are compared, small ones side by side."""

        def found(fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            fp, first = np.unique(fp, return_index=True)
            rep = rep[first]
            order = np.argsort(rep)
            fp, rep = fp[order], rep[order]
            root = forest(len(fp), *close_pairs(fp.view(np.uint64)))
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(rep[root[own]]), pa.array(rep[own])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            fp, rep, block = (np.concatenate(x) for x in zip(*held))
            at = 0
            for to in np.flatnonzero(np.diff(block)) + 1:
                if to - at >= BLOCK:
                    yield found(fp[at:to], rep[at:to])
                    at = to
            held = [(fp[at:], rep[at:], block[at:])]  # its last block may go on in the next batch
        if held:
            yield found(held[0][0], held[0][1])

    return placed.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp (64 bits as a long), component_id (the smallest doc_id reachable)."""
    found = stored(fingerprints(docs), "fingerprints")
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    # a doc_id that comes with several texts ties their classes together
    pairs = found.filter("doc_id is not null").distinct()
    several = pairs.join(pairs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1"), "doc_id", "left_semi")
    shared = several.join(classes, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = links(classes.filter("rep is not null").select("fp", "rep"), classes.count()).unionByName(shared)
    of = components(edges)
    named = classes.join(of, classes["rep"] == of["node"], "left").select("fp", "rows", F.coalesce("component", "rep").alias("component_id"))
    return join_counted(found, stored(named, "named"), "fp", "rows", found.count()).select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id, in all their columns. Rows with a null doc_id stay."""
    kept = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_townwire_id")).distinct()
    return docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col("_townwire_id"), "left_semi").unionByName(docs.filter("doc_id is null"))
