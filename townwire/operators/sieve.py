"""N-grams of texts against a Bloom filter of a large lexicon: the longest that pass, a handful a text.

Texts are taken a slice at a time as arrays of code points. Prefix sums of a polynomial over
them give the hash of any stretch at once, so no string is made for an n-gram unless it is sent
on. Passing means nothing but that the lexicon has to be asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of the filter (2^30: 128 MB), bits for each surface up to there, and probes at most.
MOST_BITS, SURFACE_BITS, PROBES = 1 << 30, 16, 8
#: Bits of one shard, so that more surfaces have more shards, and tasks that build them.
SHARD_BITS = 1 << 20
#: Different n-grams that a text sends on, and all others of the last one's length; one more for so many tokens, as more may pass by chance.
SENT, MORE_TOKENS = 8, 256
#: Characters of texts that are read at once; a longer text is read in pieces.
SLICE_CHARS = 1 << 18
WORD, OTHER = 1, 2
BASE = 0x9E3779B97F4A7C15


def bits_for(surfaces: int) -> int:
    """A power of two. Beyond MOST_BITS the filter fills up, which lets more n-grams through but never fewer."""
    return min(MOST_BITS, max(SHARD_BITS, 1 << (max(1, SURFACE_BITS * surfaces) - 1).bit_length()))


@cache
def kinds() -> np.ndarray:
    """What each code point is to lexicon.TOKEN: white space (0), part of a word, or a token of its own."""
    import regex

    # the surrogates are no characters
    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, runs in ((WORD, r"[\p{L}\p{N}_]+"), (0, r"\s+")):
        for m in regex.finditer(runs, signs):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, 2^bits of each."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))


class Slice:
    """Lower-cased texts as one array of code points, with a text's tokens and hashes of its stretches."""

    def __init__(self, lows: list[str]):
        self.text = "\n".join(lows)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        kind = kinds()[points]
        self.edges = np.cumsum([0, *(len(t) + 1 for t in lows)])
        power, self.inverse = _powers(max(18, len(points).bit_length()))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        # white space of any kind counts as a space
        np.cumsum(np.where(kind == 0, np.uint32(32), points) * power[: len(points)], out=self.sums[1:])
        word, alone = np.pad(kind == WORD, 1), kind == OTHER
        self.starts = np.flatnonzero(alone | (word[1:-1] & ~word[:-2]))
        self.ends = np.flatnonzero(alone | (word[1:-1] & ~word[2:])) + 1
        #: For each text, and behind the last, the first of its tokens.
        self.first = np.searchsorted(self.starts, self.edges)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Sieve:
    """The filter's packed bits, shard after shard."""

    def __init__(self, packed: np.ndarray, probes: int):
        self.packed, self.probes, self.shards = packed, probes, len(packed) * 8 // SHARD_BITS

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes pass, by number."""
        at = np.arange(len(hashes))
        shard = shard_of(hashes, self.shards) * SHARD_BITS
        for k in range(self.probes):
            place = shard + probe(hashes, k)
            held = np.flatnonzero(self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
            at, hashes, shard = at[held], hashes[held], shard[held]
        return at


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(54)).astype(np.int64) % shards


def probe(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th place of each hash in its shard."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes + np.uint64(k) * step) & np.uint64(SHARD_BITS - 1)).astype(np.int64)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surfaces, in the first column, with their lower-cased text, their number of tokens and their hash."""
    for batch in batches:
        for some in _slices(batch, 0):
            lows = [(s or "").lower() for s in some.column(0).to_pylist()]
            cut = Slice(lows)
            hashes = cut.hashes(cut.edges[:-1], cut.edges[1:] - 1).view(np.int64)
            columns = [pa.array(lows, pa.string()), pa.array(np.diff(cut.first), pa.int32()), pa.array(hashes)]
            yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*batch.schema.names, "low", "n", "hash"])


def build(rows: DataFrame, surfaces: int) -> Callable[[], Sieve]:
    """The filter of rows' hashes, for tasks. Hashes go to the shard of their top bits; only packed shards reach the driver, MOST_BITS at most."""
    bits = bits_for(surfaces)
    shards, probes = bits // SHARD_BITS, min(PROBES, max(1, round(0.69 * bits / surfaces)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            shard = shard_of(hashes, shards)
            for s in np.unique(shard).tolist():
                own = filled.setdefault(s, np.zeros(SHARD_BITS, bool))
                for k in range(probes):
                    own[probe(hashes[shard == s], k)] = True
        if filled:
            yield pa.RecordBatch.from_arrays([pa.array(list(filled), pa.int32()), pa.array([np.packbits(x).tobytes() for x in filled.values()], pa.binary())], names=["shard", "packed"])

    shard = F.pmod(F.shiftrightunsigned("hash", 54), F.lit(shards)).cast("int").alias("shard")
    packed = np.zeros((shards, SHARD_BITS // 8), np.uint8)
    for r in rows.select(shard, "hash").repartition(shards, "shard").mapInArrow(fill, "shard int, packed binary").collect():
        packed[r["shard"]] = np.frombuffer(r["packed"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(packed.ravel())
    return lambda: Sieve(sent.value, probes)


def longest(sieve: Callable[[], Sieve], lengths: list[int]):
    """For mapInArrow over (key, text): of texts with n-grams that pass, the longest (SENT) and those as long as the last of these; and the length of the longest that was kept back, or 0. A text of several pieces has several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        space, own = regex.compile(r"\s"), sieve()
        for batch in batches:
            for some in _slices(batch, 1):
                lows = [(t or "").lower() for t in some.column(1).to_pylist()]
                for part in [lows] if len(lows) > 1 else ([p] for p in pieces(lows[0], lengths[-1])):
                    cut = Slice(part)
                    at, back, a, b = chosen(cut, own, lengths)
                    texts, first = np.unique(at, return_index=True)
                    strings = [space.sub(" ", cut.text[i:j]) for i, j in zip(a.tolist(), b.tolist())]
                    sent = [list(set(strings[i:j])) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(strings)])]
                    columns = [some.column(0).take(pa.array(texts)), pa.array(back[texts], pa.int32()), pa.array(sent, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "_townwire_back", "_townwire_low"])

    return run


def pieces(low: str, most: int, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A text in pieces that end at white space, such that each n-gram of up to most tokens is whole in one of them."""
    import regex

    space, block = regex.compile(r"\s"), regex.compile(r"\S+")
    start = 0
    while len(low) - start > chars and (gap := space.search(low, start + chars)):
        end = gap.end()
        for _ in range(most):  # a block has one token at least
            end = m.end() if (m := block.search(low, end)) else len(low)
        yield low[start:end]
        start = gap.end()
    yield low[start:]


def chosen(cut: Slice, sieve: Sieve, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams to send the text, where they start and where they end, text by text; and the longest length kept back, of each text."""
    counts = np.diff(cut.first)
    home, last = np.repeat(np.arange(len(counts)), counts), np.repeat(cut.first[1:], counts)
    found = []
    for n in lengths:
        i = np.flatnonzero(np.arange(len(home)) + n <= last)
        a, b = cut.starts[i], cut.ends[i + n - 1]
        hashes = cut.hashes(a, b)
        held = sieve.passed(hashes)
        found.append((home[i[held]], a[held], b[held], hashes[held]))
    at, a, b, hashes = (np.concatenate(x) for x in zip(*found))
    size = b - a
    order = np.lexsort((hashes, -size, at))
    at, a, b, size, hashes = at[order], a[order], b[order], size[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    # the how-manieth of a text's different n-grams
    rank = np.cumsum(new)
    rank -= np.concatenate([[0], rank])[np.searchsorted(at, at)]
    least, back = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    limit = rank == (SENT + counts // MORE_TOKENS)[at]
    least[at[limit]] = size[limit]
    kept = size >= least[at]
    np.maximum.at(back, at[~kept], size[~kept])
    return at[kept], back, a[kept], b[kept]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows whose strings hold SLICE_CHARS bytes together, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(whole, whole[i] - sizes[i] + SLICE_CHARS, side="right")))
        yield batch.slice(i, j - i)
        i = j
