"""Substring dedup: windows of words that occur elsewhere, found with FM-indexes per shard.

1. Rows get a number each and are stored. One map cuts every text's windows into runs that
   share their minimiser, the smallest hash of ``GRAM`` words inside the window. Equal windows
   have equal minimisers, wherever they stand, so runs are dealt by minimiser and never leave
   out a repeat.
2. Runs whose minimiser occurs once end there. Of equal runs two copies of the words go on,
   with their number.
3. Each shard builds FM-indexes over the runs of its minimisers and streams the same runs
   against them: backward search over the wavelet matrix gives matching statistics, which
   report the windows that occur twice. Where a run has a copy with the same words, all of its
   windows do, which needs no search.
   A minimiser with more than ``SHARD_RUNS`` different runs is split: its runs are trimmed to
   the windows that two Bloom filters suspect to occur twice, as mostly they are runs around
   one common passage that differ in what stands beside it. Where that leaves too many, they
   are split into single windows, each with its own hash for a minimiser. All parts go to
   indexes like the others.
4. What is reported goes back to the documents, which drop the words it covers.

Windows are judged on the input. Defined cases: a null text has no words; texts under one
window keep all their words; identical rows (same doc_id, same text) are copies of each
other; a null doc_id is no obstacle, as rows have numbers of their own; an empty table gives
no rows; no text is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.bloom import Twice, bits_for, twice_filters
from townwire.llm.common import append_columns, join_counted, map_slices, stored, texts, with_text

WINDOW, GRAM = 35, 8
#: Column that holds the number of a row.
ROW = "_townwire_row"
#: Different runs of one minimiser that go to an index as they are, and words that one index takes.
SHARD_RUNS, SHARD_WORDS = 1_000, 120_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The base's inverse modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def runs_of(words: list[bytes], powers: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Per run of windows that share their minimiser: its hash, two hashes of the run, first window, number of windows."""
    import xxhash

    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    gram = min(GRAM, window)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * BASE + h[k : n - gram + 1 + k]
    grams = mix(grams)
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1), axis=1) + np.arange(n - window + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    count = np.diff(np.append(first, n - window + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[0][:n], dtype=np.uint64)])
    own = mix((sums[first + count + window - 1] - sums[first]) * powers[1][first]) + count.astype(np.uint64)
    # the words' hashes in another order of their bits, summed with the same powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers[0][:n], dtype=np.uint64)])
    check = mix((sums[first + count + window - 1] - sums[first]) * powers[1][first])
    return grams[least[first]].view(np.int64), own.view(np.int64), check.view(np.int64), first.astype(np.int32), count.astype(np.int32)


def powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
    return ones(BASE), ones(INVERSE)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, stored, so that it stays the same."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def all_runs(rows: DataFrame, window: int) -> DataFrame:
    def run(slices):
        powers = powers_up_to(1 << 14)
        for x in slices:
            parts = []
            for row, text in zip(x["row"], x["text"]):
                words = text.encode().split()
                if len(words) >= window:
                    if len(words) > len(powers[0]):
                        powers = powers_up_to(2 * len(words))
                    got = runs_of(words, powers, window)
                    parts.append((*got, np.full(len(got[0]), row)))
            if parts:
                yield dict(zip(("mini", "run", "check", "first", "n", "row"), map(np.concatenate, zip(*parts))))

    return map_slices(rows, run, "mini long, run long, check long, first int, n int, row long")


def with_words(rows: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The chosen runs' own words, cut out of the rows that stand for them."""
    kept = ("mini", "run", "check", "times", "n", "crowded")

    def run(slices):
        for x in slices:
            out = {k: [] for k in (*kept, "words")}
            for text, wanted in zip(x["text"], x["wanted"]):
                words = text.encode().split()
                for w in wanted:
                    for k in kept:
                        out[k].append(w[k])
                    out["words"].append(b" ".join(words[w["first"] : w["first"] + w["n"] + window - 1]))
            yield out

    by_row = chosen.groupBy("row").agg(F.collect_list(F.struct(*kept, "first")).alias("wanted"))  # at most as many as the row has runs
    return map_slices(rows.join(by_row, "row").select("text", "wanted"), run, "mini long, run long, check long, times long, n int, crowded boolean, words binary")


HITS = "mini long, run long, check long, times long, spans array<struct<from:int,to:int>>"


def indexed(runs: DataFrame, window: int) -> DataFrame:
    """Per run the windows that occur twice, by FM-indexes of the runs of each minimiser: (mini, run, check, times, spans), a span's last window included.

    runs: (mini, run, check, times, n, words), of runs with times > 1 one row or two.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from townwire.llm.fmindex import FMIndex

        def found(part: pa.Table) -> pa.RecordBatch:
            n = part.column("n").to_numpy().astype(np.int64)
            keys = np.stack([part.column(k).to_numpy() for k in ("mini", "run", "check")])
            words = part.column("words").to_pylist()
            same = np.concatenate([[False], (keys[:, 1:] == keys[:, :-1]).all(axis=0)])  # a second copy
            copied = np.zeros(len(words), bool)
            for i in np.flatnonzero(same):
                copied[i - 1] = words[i] == words[i - 1]
            texts = np.flatnonzero(~(same & np.concatenate([[False], copied[:-1]])))  # copies that the words confirm needn't be indexed twice
            split = [words[i].split() for i in texts]
            ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for t in split for w in t))}
            index = FMIndex([np.fromiter(map(ids.__getitem__, t), np.int32, len(t)) for t in split], len(ids) + 1)
            alone = np.flatnonzero(~copied[texts])
            spans: dict[int, list[dict]] = {int(i): [{"from": 0, "to": int(n[i]) - 1}] for i in np.flatnonzero(copied)}
            for text, a, b in index.repeated_windows(alone, n[texts[alone]], window):
                spans.setdefault(int(texts[text]), []).append({"from": a, "to": b})
            at = list(spans)
            columns = [pa.array(k[at]) for k in keys] + [part.column("times").take(pa.array(at, pa.int64())).combine_chunks(), pa.array(list(spans.values()), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
            return pa.RecordBatch.from_arrays(columns, names=["mini", "run", "check", "times", "spans"])

        size_of = lambda b: int(np.sum(b.column(b.schema.get_field_index("n")).to_numpy())) + b.num_rows * (window - 1)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                held.append(part)
                size += size_of(part)
                if size >= SHARD_WORDS:
                    table = pa.Table.from_batches(held)
                    ends = np.flatnonzero(np.diff(table.column("mini").to_numpy())) + 1
                    if len(ends):  # the last minimiser's runs may go on
                        yield found(table.slice(0, ends[-1]))
                        held = table.slice(ends[-1]).to_batches()
                        size = sum(map(size_of, held))
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = runs.select("mini", "run", "check", "times", "n", "words").repartition("mini").sortWithinPartitions("mini", "run", "check")
    found = dealt.mapInArrow(search, HITS)
    # copies that their hashes take for one, but not their words, would come twice
    return found.groupBy("mini", "run", "check").agg(F.max("times").alias("times"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def window_hashes(words: list[bytes], powers: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[0][: len(h)], dtype=np.uint64)])
    return mix((sums[window:] - sums[:-window]) * powers[1][: len(h) - window + 1])


def trimmed(crowded: DataFrame, window: int) -> DataFrame:
    """Runs cut down to their suspected windows: (mini, run, check, times, offset, n, words)."""
    powers = powers_up_to(4 * window)  # a run has fewer words than two windows

    def all_hashes(x: dict) -> list[np.ndarray]:
        return [np.repeat(window_hashes(w.split(), powers, window), min(t, 2)) for w, t in zip(x["words"], x["times"])]

    bits = bits_for(crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    sent = crowded.sparkSession.sparkContext.broadcast(twice_filters(crowded.select("words", "times"), all_hashes, bits))  # a bounded number of bits

    def run(slices):
        twice = Twice(sent.value, bits)
        for x in slices:
            out = {k: [] for k in ("mini", "run", "check", "times", "offset", "n", "words")}
            for mini, own, check, times, text in zip(x["mini"], x["run"], x["check"], x["times"], x["words"]):
                words = text.split()
                steps = np.diff(np.concatenate([[0], twice.test(window_hashes(words, powers, window)), [0]]).astype(np.int8))
                for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)):
                    for k, v in zip(out, (mini, own, check, times, a, b - a, b" ".join(words[a : b + window - 1]))):
                        out[k].append(v)
            yield out

    return map_slices(crowded.select("mini", "run", "check", "times", "words"), run, "mini long, run long, check long, times long, offset int, n int, words binary")


def single_windows(parts: DataFrame, window: int) -> DataFrame:
    """Parts of runs as single windows, each under a minimiser of its own: what trimmed gives."""
    powers = powers_up_to(4 * window)

    def run(slices):
        for x in slices:
            out = {k: [] for k in ("part_mini", "mini", "run", "check", "times", "offset", "n", "words")}
            for mini, own, check, times, offset, text in zip(*(x[k] for k in ("mini", "run", "check", "times", "offset", "words"))):
                words = text.split()
                for at, h in enumerate(window_hashes(words, powers, window).view(np.int64)):
                    for k, v in zip(out, (h, mini, own, check, times, offset + at, 1, b" ".join(words[at : at + window]))):
                        out[k].append(v)
            yield out

    return map_slices(parts.select("mini", "run", "check", "times", "offset", "words"), run, "part_mini long, mini long, run long, check long, times long, offset int, n int, words binary")


def split_further(crowded: DataFrame, window: int) -> DataFrame:
    """What indexed() gives, for the runs of crowded minimisers."""
    parts = stored(trimmed(crowded.filter("copy = 0"), window), "trimmed")
    kinds = parts.groupBy("mini").agg(F.count_distinct("words").alias("kinds"), F.count("*").alias("rows"))
    sized = stored(join_counted(parts, kinds, "mini", "rows", parts.count()), "sized")
    own = sized.filter(F.col("kinds") <= SHARD_RUNS).withColumn("part_mini", F.col("mini"))
    single = single_windows(sized.filter(F.col("kinds") > SHARD_RUNS), window)
    columns = ("part_mini", "mini", "run", "check", "times", "offset", "n", "words")
    pieces = stored(own.select(*columns).unionByName(single.select(*columns)).withColumn("part", F.xxhash64("words", "n")).withColumn("part_check", F.crc32("words")), "pieces")
    key = ["part_mini", "part", "part_check"]
    # equal parts as runs of their own; of several one's words stand for two copies
    each = pieces.groupBy(*key).agg(F.sum("times").alias("times"), F.count("*").alias("rows"), F.min("n").alias("n"), F.min("words").alias("words"), F.max("words").alias("last"))
    copies = F.when((F.col("times") > 1), F.array("words", "last")).otherwise(F.array("words"))
    hits = indexed(each.select(F.col("part_mini").alias("mini"), F.col("part").alias("run"), F.col("part_check").alias("check"), "rows", "n", F.explode(copies).alias("words")).withColumnRenamed("rows", "times"), window)
    hits = hits.select(F.col("mini").alias("part_mini"), F.col("run").alias("part"), F.col("check").alias("part_check"), F.col("times").alias("rows"), "spans")
    placed = join_counted(pieces.select(*key, "mini", "run", "check", "times", "offset"), stored(hits, "part-hits"), key, "rows", pieces.count())
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("offset")).alias("from"), (s["to"] + F.col("offset")).alias("to")))
    return placed.groupBy("mini", "run", "check").agg(F.max("times").alias("times"), F.flatten(F.collect_list(moved)).alias("spans"))  # at most as many spans as windows


def covered(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, spans) of rows with words to remove; rows: row, text. A span is its first window and its last."""
    runs = stored(all_runs(rows, window), "runs")
    repeated = stored(runs.groupBy("mini").agg(F.count("*").alias("all")).filter("all > 1"), "repeated")
    runs = stored(join_counted(runs, repeated, "mini", "all", runs.count()).drop("all"), "suspects")
    place = F.struct("row", "first", "n")
    kinds = stored(runs.groupBy("mini", "run", "check").agg(F.count("*").alias("times"), F.min(place).alias("one"), F.max(place).alias("two")), "kinds")
    different = kinds.groupBy("mini").agg(F.count("*").alias("kinds"))
    copies = F.when(F.col("times") > 1, F.array("one", "two")).otherwise(F.array("one"))
    chosen = join_counted(kinds, different, "mini", "kinds", kinds.count()).select("mini", "run", "check", "times", (F.col("kinds") > SHARD_RUNS).alias("crowded"), F.explode(copies).alias("at"))
    words = stored(with_words(rows, chosen.select("mini", "run", "check", "times", "crowded", "at.*"), window), "words")
    hits = indexed(words.filter("not crowded"), window)
    if not (crowded := words.filter("crowded")).isEmpty():
        # equal words of a run's two copies are one row; where they differ both stay, and both are searched
        one = crowded.groupBy("mini", "run", "check", "words").agg(F.max("times").alias("times"), F.max("n").alias("n"))
        hits = hits.unionByName(split_further(one.withColumn("copy", F.lit(0)), window))
    hits = stored(hits, "hits")
    spans = join_counted(runs.select("mini", "run", "check", "row", "first"), hits, ["mini", "run", "check"], "times", runs.count())
    own = F.transform("spans", lambda s: F.struct((F.col("first") + s["from"]).alias("a"), (F.col("first") + s["to"]).alias("b")))
    return spans.groupBy("row").agg(F.flatten(F.collect_list(own)).alias("spans"))  # at most as many as the row has windows


def without(words: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    """The words that no span covers."""
    if not spans:
        return words
    steps = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        steps[s["a"]] += 1
        steps[s["b"] + window] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and the kept words joined by one space."""

    def run(slices):
        for x in slices:
            words = [t.encode().split() for t in x["text"]]
            kept = [without(w, spans, window) for w, spans in zip(words, x["spans"])]
            yield {"doc_id": x["doc_id"], "n_words": [len(w) for w in words], "n_removed": [len(w) - len(k) for w, k in zip(words, kept)], "kept": [b" ".join(k).decode() for k in kept]}

    rows = numbered(texts(docs)).withColumnRenamed(ROW, "row")
    joined = rows.join(covered(rows.select("row", "text"), window), "row", "left").select("doc_id", "text", "spans")
    return map_slices(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the covered words, in all their columns; texts that lose none stay as they are, white space and all."""
    rows = numbered(docs)
    spans = covered(rows.select(F.col(ROW).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")), window).select(F.col("row").alias(ROW), F.col("spans").alias("_townwire_spans"))
    joined = rows.join(spans, ROW, "left")
    rewrite = lambda x: {"_townwire_text": [t if not s else b" ".join(without(t.encode().split(), s, window)).decode() for t, s in zip(x["text"], x["_townwire_spans"])]}
    return with_text(append_columns(joined, ["text", "_townwire_spans"], rewrite, "_townwire_text string"), docs.columns, "_townwire_text")
