"""Exact ranked lexical search by norm buckets of impact vectors.

A document's impact vector has a whole number for each term that some item asks for; an
item's vector has the terms' weights. An item's score of a document is their inner product.
Items are dealt into blocks of bounded text. For each block:

1. One pass over the documents counts terms: a row per document with its number of terms
   and its counts of the block's terms. The row is stored; document frequencies, the number
   of documents and of terms follow from it.
2. Counts become impacts, and documents are ordered by the length (norm) of their vectors
   into buckets, the longest first. A bounded sample of the longest gives each item a first
   lower bound of its k-th best score.
3. Every bucket meets the block's items in a task. An item skips the bucket, or the tail of
   it, where the product of both norms is below its bound (Cauchy-Schwarz). Inside, the
   item's coordinates are taken up from the heaviest on; a document stays as long as its
   partial sum and what the other coordinates can add at most (by the two remaining norms,
   and by the largest value of each coordinate in the bucket) reach the bound. Survivors are
   scored again from their whole vectors, in integers.
4. The k best of every bucket are merged per item.

Defined cases: a null or empty text has no terms; a document without terms counts nowhere;
an item without terms, or whose terms no document has, has no rows; every row of either
table is an item or a document of its own, also where rows share an id (each item row has
its own ranks); a null doc_id comes last among equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.llm.common import map_slices, stored

#: A term is a maximal run of these characters; only A-Z are lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of item text in a block, about: bounds the terms that a task holds.
BLOCK_CHARS = 1 << 24
#: Documents in a bucket, about; documents, and numbers in their vectors, of the sample that gives the first bounds.
BUCKET, SEEDS, SEED_NUMBERS = 8_192, 2_048, 1 << 21
#: Coordinates that are taken up before candidates are compacted.
STEP = 4
#: Numbers in vectors that a task gathers at most, about: a bucket with more is searched in parts.
NUMBERS = 1 << 22
#: Enlarges bounds in floating point against rounding.
SLACK = 1 + 1e-9


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").encode().lower().decode())  # of bytes, only A-Z change


def counted(docs: DataFrame, place: dict[str, int]) -> DataFrame:
    """(doc_id, n, at, tf) for every document with a term: n terms with repeats, tf of each wanted term, by its place."""

    def run(slices):
        for x in slices:
            out: dict[str, list] = {"doc_id": [], "n": [], "at": [], "tf": []}
            for doc_id, text in zip(x["doc_id"], x["text"]):
                found = terms(text)
                if found:
                    tf = {place[t]: c for t, c in Counter(found).items() if t in place}
                    for k, v in zip(out, (doc_id, len(found), list(tf), list(tf.values()))):
                        out[k].append(v)
            yield out

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, at array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, at, x, norm): the impact of each wanted term, and their vector's length."""
    m = F.expr(f"{100 - 90} + (cast(n as decimal(20,0)) * cast({90 * n_docs} as decimal(18,0))) div {max(1, n_terms)}")
    x = F.transform("tf", lambda c: F.call_function("div", F.lit(1_000_000_000) * c, F.lit(1_000) * c + F.lit(8) * F.col("m")))
    found = counts.filter(F.size("at") > 0).withColumn("m", m).select("doc_id", "at", x.alias("x"))
    return found.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


class Bucket:
    """Documents by descending norm, with their vectors by row and by coordinate."""

    def __init__(self, table: pa.Table):
        norms = table.column("norm").to_numpy()
        order = np.argsort(-norms, kind="stable")
        ids = table.column("doc_id").combine_chunks()
        self.norms = norms[order]
        self.null = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.ids = ids.fill_null(0).to_numpy()[order]
        at, x = (table.column(c).combine_chunks() for c in ("at", "x"))
        size = at.value_lengths().to_numpy()
        self.at, self.x, self.order = at.flatten().to_numpy(), x.flatten().to_numpy(), order
        self.start = np.concatenate(([0], np.cumsum(size)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.repeat(place, size)
        by = np.lexsort((docs, self.at))  # within a coordinate by descending norm
        self.docs, self.values = docs[by], self.x[by]
        coordinates, starts = np.unique(self.at[by], return_index=True)
        most = np.maximum.reduceat(self.values, starts) if len(starts) else starts
        self.postings = {c: v for c, *v in zip(coordinates.tolist(), starts.tolist(), [*starts[1:].tolist(), len(by)], most.tolist())}

    def exact(self, doc: int, weights: dict[int, int]) -> int:
        a, b = self.start[self.order[doc]], self.start[self.order[doc] + 1]
        return sum(weights[c] * v for c, v in zip(self.at[a:b].tolist(), self.x[a:b].tolist()) if c in weights)

    def best(self, own: list[tuple[int, int]], least: int, k: int) -> tuple[list[int], list[int]]:
        """The k best documents, by place, with scores above 0 and not below least, and their scores. own: (coordinate, weight)."""
        own = [(c, w) for c, w in own if c in self.postings and w > 0]
        length = math.sqrt(sum(w * w for _, w in own)) * SLACK
        n = int(np.searchsorted(-self.norms, -(least / length) / SLACK, side="right")) if own else 0
        if n == 0:  # Cauchy-Schwarz: even the longest document can't reach it
            return [], []
        own.sort(key=lambda cw: -cw[1] * self.postings[cw[0]][2])
        sums, square, live = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        for i, (c, w) in enumerate(own):
            a, b, _ = self.postings[c]
            docs = self.docs[a : a + int(np.searchsorted(self.docs[a:b], n))]
            x = self.values[a : a + len(docs)]
            if i >= STEP:
                kept = live[docs]
                docs, x = docs[kept], x[kept]
            sums[docs] += w * x
            square[docs] += x.astype(np.float64) ** 2
            if i % STEP == STEP - 1:
                rest = own[i + 1 :]
                by_norm = math.sqrt(sum(v * v for _, v in rest)) * np.sqrt(np.maximum(self.norms[:n] ** 2 * SLACK - square, 0))
                by_coordinate = float(sum(v * self.postings[d][2] for d, v in rest))
                if n > k:  # partial sums are lower bounds of scores themselves
                    least = max(least, int(np.partition(sums, n - k)[n - k]))
                live &= sums + np.minimum(by_norm, by_coordinate) * SLACK >= least
        left = np.flatnonzero(live & (sums > 0))
        if len(left) > k:
            left = left[sums[left] >= np.partition(sums[left], len(left) - k)[len(left) - k]]
        weights = dict(own)
        found = [(-self.exact(d, weights), self.null[d], self.ids[d], d) for d in left.tolist()]
        found = sorted(f for f in found if -f[0] >= max(1, least))[:k]
        return [f[3] for f in found], [-f[0] for f in found]


def with_bounds(items: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """items (item, item_id, at, w) with least, a lower bound of their k-th best score, from a sample of documents."""

    def run(slices):
        bucket = Bucket(sample)
        for s in slices:
            scores = [bucket.best(list(zip(c, w)), 0, k)[1] for c, w in zip(s["at"], s["w"])]
            yield s | {"least": [x[-1] if len(x) == k else 0 for x in scores]}

    return map_slices(items, run, "item long, item_id long, at array<int>, w array<long>, least long")


def block_hits(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): at least each item's k best documents. items: (item, item_id, terms) of one block."""
    vocabulary = [r[0] for r in items.select(F.explode("terms")).distinct().collect()]  # at most BLOCK_CHARS
    place = {t: i for i, t in enumerate(sorted(vocabulary))}
    counts = stored(counted(docs, place), "lexical-counts")
    total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.when(F.size("at") > 0, 1)).alias("hits"), F.coalesce(F.max(F.size("at")), F.lit(0)).alias("most")).first()
    df = {r["at"]: r["count"] for r in counts.select(F.explode("at").alias("at")).groupBy("at").count().collect()}  # at most the block's terms
    weights = {t: (i, weight(total["docs"], df[i])) for t, i in place.items() if i in df}

    def weigh(slices):
        for s in slices:
            own = [[weights[t] for t in ts if t in weights] for ts in s["terms"]]
            yield {"item": s["item"], "item_id": s["item_id"], "at": [[i for i, _ in o] for o in own], "w": [[w for _, w in o] for o in own]}

    vectors = impacts(counts, total["docs"], total["terms"])
    seeds = max(1, min(SEEDS, SEED_NUMBERS // max(1, total["most"])))
    sample = vectors.orderBy(F.desc("norm"), "doc_id").limit(seeds).toArrow()  # at most SEEDS rows and SEED_NUMBERS numbers
    weighed = map_slices(items, weigh, "item long, item_id long, at array<int>, w array<long>")
    asked = [(r["item"], r["item_id"], list(zip(r["at"], r["w"])), r["least"]) for r in with_bounds(weighed, sample, k).collect()]  # one block of items
    dealt = vectors.repartitionByRange(max(1, -(-total["hits"] // BUCKET)), F.desc("norm"), F.xxhash64("doc_id", "at", "x"))

    def search_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets() -> Iterator[Bucket]:
            held, numbers = [], 0
            for b in batches:
                held += [b] * (b.num_rows > 0)
                numbers += len(b.column("at").flatten())
                if numbers >= NUMBERS:
                    yield Bucket(pa.Table.from_batches(held))
                    held, numbers = [], 0
            if held:
                yield Bucket(pa.Table.from_batches(held))

        for bucket in buckets():
            item, item_id, doc_id, score = [], [], [], []
            for row, name, own, least in asked:
                found, scores = bucket.best(own, least, k)
                item += [row] * len(found)
                item_id += [name] * len(found)
                doc_id += [None if bucket.null[d] else int(bucket.ids[d]) for d in found]
                score += scores
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (item, item_id, doc_id, score)], names=["item", "item_id", "doc_id", "score"])

    return dealt.mapInArrow(search_bucket, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item row's k best documents: item_id, rank from 1, doc_id, score."""

    def split(slices):
        for s in slices:
            yield {"item": s["item"], "item_id": s["item_id"], "terms": [list(dict.fromkeys(terms(t))) for t in s["text"]]}

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = stored(map_slices(rows, split, "item long, item_id long, terms array<string>"), "lexical-terms")
    chars = asked.agg(F.coalesce(F.sum(F.length(F.array_join("terms", " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    found = [block_hits(docs, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
