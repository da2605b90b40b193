"""Best-fit packing of token sequences by length patterns and non-negative least squares.

1. Tokenise every text, append the end id, cut what is longer than a sequence into pieces
   (the first may be shorter), keep one narrow row per piece.
2. Only the histogram of piece lengths (at most as many rows as a sequence has tokens)
   reaches the driver. There, patterns of one to three lengths that fill a sequence are
   enumerated, their repeat counts fitted to the histogram by non-negative least squares
   and rounded down (all or a large share of them, whichever packs better), and what is left
   is packed best-fit by decreasing length. Exchanges
   mend the rounding: the emptiest sequences and some others are emptied and packed anew as
   long as that saves one or gathers the room. The result is a list of runs: "these ranks of
   this length go to these sequences at this offset".
3. Each piece gets its rank among the pieces of its length, counted in three steps (within
   hashed buckets, over the buckets of a group, over groups), so a length that a third of
   all pieces share isn't ranked in one task. The run that holds the rank gives sequence and
   offset.

Defined cases: a null or empty text is one piece that holds the end id alone; rows with a
null or repeated doc_id are packed like others (a repeated doc_id has its pieces twice), as
pieces are told apart by a number of their row; an empty table gives no rows; no text is cut
short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.llm.bytepair import encoder
from townwire.llm.common import map_slices, stored, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces that one ranking bucket holds on average.
BUCKET_ROWS = 50_000
#: Buckets of one group.
GROUP = 1_000
#: Shares of the fitted repeats that are tried, as few lengths of many pieces each leave odd remainders; the fewest sequences win.
SHARES = (1.0, 0.8, 0.6, 0.4)
#: Rounds of exchanges, sequences that one empties, and the noises that the order of their pieces is tried with.
EXCHANGES, EXCHANGED, NOISES = 200, 40, (0, 30, 100, 300)
#: Patterns of three lengths that the fit may use besides all pairs.
TRIPLES = 4_000


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: its document's row, where it starts among its ids, its length, and the crc32 of its ids."""

    def run(slices):
        encode = encoder(vocabulary).encode_to_numpy
        for x in slices:
            out = {k: [] for k in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
            for row, doc_id, text in zip(x["row"], x["doc_id"], x["text"]):
                ids = np.append(encode(text, allowed_special="all"), end_id).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, value in zip(out, (row, doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        out[name].append(value)
            yield out

    return map_slices(texts(docs).withColumn("row", F.monotonically_increasing_id()), run, f"row long, {PIECES}")


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Few-document patterns: whole sequences, all pairs that fill one, and triples that do, spread over the lengths."""
    have = np.flatnonzero(counts)
    out = {(int(n),) for n in have if n == capacity}
    for a in have:
        b = capacity - a
        if 0 < b <= a and counts[b]:
            out.add((int(a), int(b)))
    triples = []
    for a in have:
        for b in have[have <= a]:
            c = capacity - a - b
            if 0 < c <= b and counts[c]:
                triples.append((int(a), int(b), int(c)))
    if len(triples) > TRIPLES:
        weight = np.array([min(counts[list(t)]) for t in triples], float)
        triples = [triples[i] for i in np.argsort(-weight, kind="stable")[:: max(1, len(triples) // TRIPLES)][:TRIPLES]]
    return sorted(out) + triples


def fit(pats: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by projected gradients with momentum."""
    if not pats:
        return np.zeros(0)
    rows = np.concatenate([np.array(p) for p in pats])
    cols = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    forward = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda r: np.bincount(cols, r[rows], len(pats))
    v = np.ones(len(pats))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(1e-9, 1.02 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (new - x) @ (y - new) > 0:  # the momentum points uphill: start it anew
            t_new = 1.0
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over a histogram: {lengths of a sequence: repeats}, at cost of bins, not of pieces."""
    left, out = counts.copy(), Counter()
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern, room = [first], capacity - first
        left[first] -= 1
        while room and (fits := np.flatnonzero(left[: room + 1])).size:
            pattern.append(int(fits[-1]))
            left[fits[-1]] -= 1
            room -= int(fits[-1])
        used = Counter(pattern)
        more = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= more * k
        out[tuple(pattern)] += 1 + more
    return out


def repacked(pieces: list[int], capacity: int) -> list[list[int]]:
    """Best-fit in the given order."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for n in pieces:
        i = bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, k = rooms.pop(i)
        else:
            room, k = capacity, len(out)
            out.append([])
        out[k].append(n)
        if room > n:
            insort(rooms, (room - n, k))
    return out


def exchanged(chosen: Counter, capacity: int) -> Counter:
    """The same pieces after exchanges, of which each saves a sequence or gathers room in fewer. Their cost doesn't depend on the number of pieces."""
    rng = np.random.default_rng(0)
    square = lambda packed: -sum(sum(q) ** 2 * n for q, n in packed)
    for _ in range(EXCHANGES):
        taken: Counter = Counter()
        for q in sorted((q for q in chosen if sum(q) < capacity), key=lambda q: (sum(q), q)):
            taken[q] = min(chosen[q], EXCHANGED // 2 - taken.total())
            if taken.total() >= EXCHANGED // 2:
                break
        if not taken:
            break
        others = sorted(q for q, n in chosen.items() if len(q) > 1 and n > taken[q])
        taken.update(others[i] for i in rng.permutation(len(others))[: EXCHANGED // 2])
        pieces = np.array([n for q, k in taken.items() for n in q * k])
        if -(-int(pieces.sum()) // capacity) >= taken.total():
            continue
        tried = [repacked(pieces[np.argsort(-(pieces + rng.random(len(pieces)) * noise), kind="stable")].tolist(), capacity) for noise in NOISES]
        best = min(tried, key=lambda t: (len(t), square((q, 1) for q in t)))
        if (len(best), square((q, 1) for q in best)) < (taken.total(), square(taken.items())):
            chosen = chosen - taken
            chosen.update(tuple(sorted(q, reverse=True)) for q in best)
    return chosen


def rounded(pats: list[tuple[int, ...]], x: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """The fitted repeats rounded down, as far as the stock goes, and the rest best-fit."""
    left, chosen = counts.copy(), Counter()
    for i in np.argsort(-x, kind="stable"):
        need = Counter(pats[i])
        n = min([int(x[i] + 1e-6), *(int(left[a]) // k for a, k in need.items())])
        if n > 0:
            chosen[pats[i]] += n
            for a, k in need.items():
                left[a] -= n * k
    chosen.update(best_fit(left, capacity))
    return chosen


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks: length, first rank, first sequence, offset. Their number depends on the lengths, not on the pieces."""
    counts = counts.astype(np.int64)
    pats = patterns(counts, capacity)
    x = fit(pats, counts.astype(float))
    bound = -(-int(counts @ np.arange(len(counts))) // capacity)
    chosen: Counter | None = None
    for share in SHARES:
        tried = exchanged(rounded(pats, share * x, counts, capacity), capacity)
        if chosen is None or tried.total() < chosen.total():
            chosen = tried
        if chosen.total() <= bound:
            break
    runs, rank, sequence = [], Counter(), 0
    for pattern, n in sorted(chosen.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    runs.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(runs, np.int64).reshape(-1, 4).T))


def ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Each piece with its rank among those of its length, from 0."""
    n_buckets = max(8, -(-n_pieces // BUCKET_ROWS))
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(n_buckets)))
    within = W.partitionBy("length", "bucket").orderBy("row", "piece")
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    sizes = p.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = sizes.groupBy("length", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("length", "group", F.coalesce(F.sum("n").over(before("length").orderBy("group")), F.lit(0)).alias("group_first"))
    starts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before("length", "group").orderBy("bucket")), F.lit(0))).join(groups, ["length", "group"])
    starts = starts.select("length", "bucket", (F.col("first") + F.col("group_first")).alias("first"))
    return p.withColumn("at", F.row_number().over(within)).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("at") - 1)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its sequence and its place there; places are gapless from 0."""
    pieces = stored(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    runs = plan(counts, capacity)
    total = int(counts.sum()) + 1

    def place(slices):
        keys = runs["length"] * total + runs["rank"]
        for x in slices:
            k = np.searchsorted(keys, x["length"] * total + x["rank"], "right") - 1
            yield x | {"sequence_id": runs["sequence"][k] + x["rank"] - runs["rank"][k], "offset": runs["offset"][k]}

    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_slices(ranked(pieces, total).select(*columns), place, PACKED)
