"""Exact top-k search by columnar branch-and-bound.

Vectors become whole numbers, floor(scale * x). A bounded sample of candidates first gives
every query a lower bound of its k-th best score. Then queries and candidates are dealt into
blocks of bounded size; every query block meets every candidate block in a task. There,
candidates stand in vertical layout (a row per dimension). A query's inner products
accumulate dimension block by dimension block, and after each the surviving candidates are
compacted: a candidate stays if what it has plus the most that the remaining mass allows
(product of the two remaining norms) reaches the query's k-th best full score so far, in
the sample or in this block. Equal scores are never pruned, so ties go to the smaller id
exactly.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a
null vec_id, take no part; a shorter vector counts as padded with zeros; every row is a
query and a candidate of its own, also where rows share a vec_id (each has its own ranks),
and only meets not itself; with fewer candidates than k all are returned; components and
scores of any size are exact, but a score beyond a long is given as the nearest long, in the
order of the exact scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.llm.common import map_slices, stored

#: Dimensions that are added before candidates are compacted.
STEP = 16
#: Bounds of a candidate block and of a query block, bounds of the numbers in one, and queries whose first sums stand side by side.
CANDIDATES, QUERIES, NUMBERS, ABREAST = (1_024, 65_536), 65_536, 1 << 22, 64
#: Candidates of the sample that gives the first bounds.
SEEDS = 2_048
SCHEMA = "query long, query_id long, vec_id long, score long, wide binary"
LONG = (-(1 << 63), (1 << 63) - 1)
#: Bytes of a score beyond a long: products of doubles take under 2,048 bits, sums of them a few more.
WIDE_BYTES = 264


def integer_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, v): the whole numbers of the rows that take part, as little-endian doubles, which hold them exactly."""

    def run(slices):
        most = np.finfo(np.float64).max
        for x in slices:
            rows, ids, out = [], [], []
            for row, vec_id, e in zip(x["row"], x["vec_id"], x["embedding"]):
                if vec_id is not None and e is not None and None not in e:
                    v = np.asarray(e, np.float64)
                    if np.isfinite(v).all():
                        with np.errstate(over="ignore"):
                            v = np.clip(np.floor(scale * v), -most, most)
                        rows.append(row)
                        ids.append(vec_id)
                        out.append(v.astype("<f8").tobytes())
            yield {"row": rows, "vec_id": ids, "v": out}

    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return map_slices(rows, run, "row long, vec_id long, v binary")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """A row per dimension."""
    out = np.zeros((len(vectors), width // 8))
    for row, v in zip(out, vectors):
        row[: len(v) // 8] = np.frombuffer(v, "<f8")
    return np.ascontiguousarray(out.T)


def is_exact(q: np.ndarray, v: np.ndarray) -> bool:
    """Can doubles hold all inner products of the two and what adds up to them?"""
    return float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, len(q)) < 1 << 53


def kth(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def search_block(query_rows: np.ndarray, q: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query, by place, the k best of the candidates: (place, vec_ids, scores). q and v have a row per dimension; least bounds the k-th best scores from below."""
    dims, n = v.shape
    if not is_exact(q, v):
        yield from search_wide(query_rows, q, rows, ids, v, k)
        return
    cuts = [*range(0, dims, STEP), dims] if dims else [0, 0]
    # remaining mass behind each cut, a little enlarged against rounding
    rest = lambda m: [np.sqrt((m[c:] ** 2).sum(axis=0)) * (1 + 1e-9) for c in cuts]
    q_rest, v_rest = rest(q), rest(v)
    for row in range(len(query_rows)):
        if row % ABREAST == 0:
            first = q[: cuts[1], row : row + ABREAST].T @ v[: cuts[1]]
        sums = first[row % ABREAST]
        own = rows != query_rows[row]
        # full scores of the candidates that lead so far bound the k-th best from below
        bound = sums + q_rest[1][row] * v_rest[1]
        lead = np.argpartition(-bound, min(4 * k, n - 1))[: 4 * k] if n > 4 * k else np.arange(n)
        lead = lead[own[lead]]
        floor = max(least[row], kth(sums[lead] + q[cuts[1] :, row] @ v[cuts[1] :, lead], k))
        left = np.flatnonzero((bound >= floor) & own)
        sums = sums[left]
        for i in range(1, len(cuts) - 1):
            a, b = cuts[i], cuts[i + 1]
            sums = sums + q[a:b, row] @ v[a:b, left]
            live = sums + q_rest[i + 1][row] * v_rest[i + 1][left] >= floor
            left, sums = left[live], sums[live]
        best = np.lexsort((ids[left], -sums))[:k]
        yield row, ids[left[best]], sums[best]


def search_wide(query_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for numbers too large for doubles, in whole numbers of any size and without bounds."""
    whole = lambda m: np.array([[int(x) for x in line] for line in m], object).reshape(m.shape)
    q, v = whole(q), whole(v)
    for row in range(len(query_rows)):
        sums = q[:, row] @ v if len(v) else np.zeros(len(ids), object)
        order = sorted(np.flatnonzero(rows != query_rows[row]), key=lambda i: (-sums[i], ids[i]))[:k]
        yield row, ids[order], sums[order]


def seeded(queries: DataFrame, sample: list, width: int, k: int) -> DataFrame:
    """queries (row, vec_id, v) with least, a lower bound of their k-th best score."""
    rows = np.array([r["row"] for r in sample], np.int64)
    s = matrix([r["v"] for r in sample], width)

    def run(slices):
        for x in slices:
            q = matrix(x["v"], width)
            scores = q.T @ s if is_exact(q, s) else np.full((len(x["v"]), 0), 0.0)
            least = [kth(line[rows != row] if len(line) else line, k) for row, line in zip(x["row"], scores)]
            yield x | {"least": least}

    return map_slices(queries, run, "row long, vec_id long, v binary, least double")


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Queries: rows whose vec_id is divisible by every. Returns query_id, rank from 1, vec_id, score (inner product)."""
    vectors = stored(integer_vectors(table, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("q"), F.coalesce(F.max(F.length("v")), F.lit(0)).alias("width")).first()
    width = size["width"]
    most = max(1, NUMBERS // max(1, width // 8))
    n_c = max(1, -(-size["n"] // min(max(size["n"] // 64, CANDIDATES[0]), CANDIDATES[1], most)))
    n_q = max(1, -(-size["q"] // min(QUERIES, most)))
    at = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(min(SEEDS, most)).select("row", "v").collect()  # at most SEEDS rows
    candidates = vectors.withColumn("c", at(n_c)).withColumn("q", each(n_q))
    queries = seeded(vectors.filter(is_query), sample, width, k).withColumn("q", at(n_q)).withColumn("c", each(n_c))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        query, query_id, vec_id, score, wide = [], [], [], [], []
        if left.num_rows and right.num_rows:
            column = lambda t, name: t.column(name).to_numpy()
            own, own_id = column(left, "row"), column(left, "vec_id")
            q, v = (matrix(t.column("v").to_pylist(), width) for t in (left, right))
            for place, ids, scores in search_block(own, q, column(left, "least"), column(right, "row"), column(right, "vec_id"), v, k):
                whole = [int(s) for s in scores]
                query += [own[place]] * len(ids)
                query_id += [own_id[place]] * len(ids)
                vec_id.append(ids)
                score += [min(max(s, LONG[0]), LONG[1]) for s in whole]
                wide += [None if LONG[0] < s < LONG[1] else (s + (1 << 8 * WIDE_BYTES - 1)).to_bytes(WIDE_BYTES, "big") for s in whole]
        return pa.table({
            "query": pa.array(query, pa.int64()), "query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(np.concatenate(vec_id) if vec_id else [], pa.int64()),
            "score": pa.array(score, pa.int64()), "wide": pa.array(wide, pa.binary()),
        })

    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(meet, SCHEMA)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
