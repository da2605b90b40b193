"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is read as pieces: any ASCII consonants and digits from 5 on in a row with the one
character behind them, white space aside. Where a piece ends depends on its own characters,
never on what stands before it, so texts without spaces are cut alike wherever a passage
stands (each CJK character is a piece). ``K`` pieces in a row are an anchor if the smallest
hash of the ``S`` pieces in a row inside them stands at either edge. Whether they are depends
on nothing outside, so equal passages have equal anchors wherever they stand.

The fingerprint holds all distinct anchor hashes, each with the place where it first stands
(keep=n: the n smallest and, so that it grows with the text, all in the lowest ``SHARE`` of
the hashes). Likeness is that of two fingerprints, matched by place: common hashes count where
at least two have the same distance between their places, as a share of all hashes of both.

The next document's text comes by one shuffle: ranges with known first rows, which are also
sent to the range before, so no task sees more than its range. A doc_id that fills several
ranges (null is one) is split by the first ``PREFIX`` characters of the texts; rows alike in
both stay together.

Defined cases: a null or empty text has the fingerprint '' (likeness 1 to another '', else
0); a text under ``K`` pieces, or of few more without any anchor, has one, all of it; places
behind the 2^24th piece of one text count as one place; rows with equal doc_id follow each
other by text, and those with a null doc_id come last; of one row the next is itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.llm.common import texts

CONSONANTS = "b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ5-9"
PIECE, K, S, SHARE = rf"[{CONSONANTS}]+[^\s{CONSONANTS}]?|[^\s{CONSONANTS}]", 6, 2, 1 / 16
#: Low bits of an entry that hold its place; the hash's 32 bits stand above.
PLACE_BITS = 24
#: Rows of one range of doc_ids, the most ranges, and the characters that order rows of one doc_id among ranges.
RANGE_ROWS, RANGES, PREFIX = 2_000, 160_000, 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def anchors(text: Column) -> Column:
    """All distinct anchors as sorted longs: hash above, place below."""
    span = K - S  # from an anchor's first inner run to its last

    def entry(hashed: Column, place: Column) -> Column:
        return F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), PLACE_BITS).bitwiseOR(F.least(place, F.lit((1 << PLACE_BITS) - 1)).cast("long"))

    def of_inner(inner: Column) -> Column:
        at = lambda i, k: F.get(inner, i + F.lit(k) if k else i)
        is_anchor = lambda i: F.least(at(i, 0), at(i, span)) <= F.least(*(at(i, k) for k in range(1, span)))
        places = F.filter(F.sequence(F.lit(0), F.size(inner) - F.lit(span + 1)), is_anchor)
        # every S-th inner run: together they cover all pieces of an anchor
        return F.sort_array(F.transform(places, lambda i: entry(F.xxhash64(*(at(i, k) for k in [*range(0, span, S), span])), i)))

    def of_pieces(pieces: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(pieces) - F.lit(S)), lambda i: F.xxhash64(*(F.get(pieces, i + F.lit(k)) for k in range(S))))
        whole = F.array(entry(F.xxhash64(F.array_join(pieces, " ")), F.lit(0)))
        short = F.when(F.size(pieces) == 0, F.array().cast("array<long>")).otherwise(whole)
        return F.when(F.size(pieces) < K, short).otherwise(let(let(inner, of_inner), lambda found: F.when(F.size(found) == 0, whole).otherwise(found)))

    def distinct(entries: Column) -> Column:
        hash_of = lambda i: F.shiftright(F.get(entries, i), PLACE_BITS)
        return F.filter(entries, lambda x, i: (i == 0) | (F.shiftright(x, PLACE_BITS) != hash_of(i - F.lit(1))))

    return let(let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), of_pieces), distinct)


def kept(entries: Column, keep: int) -> Column:
    """The keep smallest entries and all in the lowest SHARE of the hashes."""
    return F.filter(entries, lambda x, i: (i < keep) | (x < F.lit(int(SHARE * (1 << 32)) << PLACE_BITS)))


def as_text(entries: Column) -> Column:
    """The fingerprint: 14 hex digits per entry, 8 of the hash, 6 of the place."""
    return F.lower(F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), 14, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Hashes that a and b have at a common distance, as a share of all; where one of them has a single hash, any distance."""
    place = lambda e: F.shiftright(e, 1).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def distance(x: Column, y: Column) -> Column:
        same = F.shiftright(x, PLACE_BITS + 1) == F.shiftright(y, PLACE_BITS + 1)
        return F.when(same, (place(y) - place(x)) * (F.lit(1) - F.lit(2) * x.bitwiseAND(F.lit(1))))

    def of(x: Column, y: Column) -> Column:
        # sorted together, a common hash is a pair of neighbours; the lowest bit tells whose entry it is
        merged = F.sort_array(F.concat(F.transform(x, lambda e: F.shiftleft(e, 1)), F.transform(y, lambda e: F.shiftleft(e, 1) + F.lit(1))))
        apart = let(merged, lambda m: F.sort_array(F.filter(F.transform(m, lambda e, i: distance(e, F.get(m, i + F.lit(1)))), lambda d: d.isNotNull())))
        agreed = lambda ds: F.size(F.filter(ds, lambda d, i: (d == F.get(ds, i - F.lit(1))) | (d == F.get(ds, i + F.lit(1)))))
        single = F.least(F.size(x), F.size(y)) == 1
        share = lambda ds: F.when(single, F.size(ds)).otherwise(agreed(ds)) / (F.size(x) + F.size(y) - F.size(ds))
        return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(let(apart, share))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def with_next(rows: DataFrame, key: str, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """rows and, as next_<column>, the columns of the row with the next larger key; the last row's next is the first.

    made: further columns, which are computed behind the shuffle.
    """
    n_ranges = max(1, min(RANGES, rows.count() // RANGE_ROWS))
    own = F.struct(F.col(key).cast("long").alias("k"), F.left("text", F.lit(PREFIX)).alias("t"))
    firsts = rows.select(own.alias("own")).repartitionByRange(n_ranges, "own").groupBy(F.spark_partition_id().alias("p")).agg(F.min("own").alias("first")).collect()
    filled = Counter(r["first"]["k"] for r in firsts)
    # at most RANGES; texts only where a key begins several ranges
    starts = sorted({(k, t if filled[k] > 1 else "") for k, t in (r["first"] for r in firsts)}, key=lambda x: (x[0], x[1].encode())) or [(0, "")]
    start = lambda x: F.struct(F.lit(x[0]).cast("long").alias("k"), F.lit(x[1]).alias("t"))
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    # two steps of counting starts up to the row, about sqrt(ranges) comparisons each
    up_to = lambda xs: F.size(F.filter(xs, lambda s: s <= own))
    coarse = F.greatest(up_to(F.array(*(start(g[0]) for g in groups))), F.lit(1))
    fine = F.array(*(F.array(*(start(x) for x in g)) for g in groups))
    dealt = rows.withColumn("coarse", coarse).withColumn("own", F.element_at(fine, F.col("coarse")))
    dealt = dealt.withColumn("range", (F.col("coarse") - 1) * step + up_to(F.col("own")) - 1)
    is_first = F.exists("own", lambda s: (s["k"] == own["k"]) & ((s["t"] == "") | (s["t"] == own["t"])))
    before = F.pmod(F.col("range") + F.lit(len(starts) - 1), F.lit(len(starts)))
    places = F.when(is_first, F.array(F.struct(F.lit(0).alias("extra"), F.col("range")), F.struct(F.lit(1).alias("extra"), before.alias("range")))).otherwise(F.array(F.struct(F.lit(0).alias("extra"), F.col("range"))))
    sent = dealt.withColumn("place", F.explode(places)).select(*rows.columns, "place.extra", "place.range")
    sent = sent.repartition("range").withColumns(made) if made else sent
    order = W.partitionBy("range").orderBy("extra", key, "text")
    for c in columns:
        sent = sent.withColumn(f"next_{c}", F.lead(c).over(order))
    return sent.filter("extra = 0").drop("extra", "range")


def fingerprint_pairs(docs: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and the likeness to that and to the next document's."""
    entries_of = anchors if keep is None else lambda text: let(anchors(text), lambda x: kept(x, keep))
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    paired = with_next(rows, "key", ["text", "entries"], {"entries": entries_of(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    out = paired.withColumn("edited", edited).withColumn("edited_entries", entries_of(F.col("edited")))
    return out.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("entries")).alias("fingerprint"), as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
