"""Lexicons of very many surfaces: an Aho-Corasick automaton over token ids finds a text's longest surface in one pass.

A small lexicon is compiled once on the driver and sent to the tasks; each text walks over it
once, without a shuffle or a row for any n-gram. Of a larger one the tasks get a Bloom filter
(``sieve``). A text sends the longest of its n-grams that pass, a handful, to be joined with the
lexicon; if one is held, and longer than all that were kept back, it is the text's hit.

Texts that this leaves open go through automata in parts: the lexicon is dealt into parts of
bounded size by the first two tokens of its surfaces, and each part is compiled by the task that
it is shuffled to. Texts are cut alike: a part gets the stretches of a text where one of its
surfaces may begin, so that a text is sent as often as a surface has tokens at most, however many
parts there are. Tasks stream both from one sorted partition, the surfaces first; hits meet per text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.operators import sieve
from townwire.operators.lexicon import TOKEN

#: Tokens in the surfaces of one part, at most about. An automaton takes some hundred bytes a token.
PART_TOKENS = 300_000
#: Texts that are cut at once.
SLICE_ROWS = 256
HIT = "entity_id string, region string, surface string"


class Automaton:
    """Surfaces (surface, entity_id, region, ord) as sequences of token ids."""

    def __init__(self, surfaces: list[tuple[str, str, str, int]]):
        import ahocorasick
        import regex

        self.token, self.space = regex.compile(TOKEN), regex.compile(r"\s")
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        best: dict[tuple[int, ...], list[tuple]] = {}
        for surface, entity_id, region, order in surfaces:
            tokens = self.token.findall(surface.lower())
            if tokens:
                best.setdefault(tuple(self.ids.setdefault(t, len(self.ids) + 1) for t in tokens), []).append((-len(surface), order, surface.lower(), entity_id, region))
        for key, found in best.items():
            self.automaton.add_word(key, (len(key), sorted(found)))
        if best:
            self.automaton.make_automaton()
        self.empty = not best

    def longest(self, text: str) -> tuple | None:
        """(minus its length, ord, surface, entity_id, region) of the longest surface between edges of words; equal lengths by ord, then by surface. A space of a surface stands for one character of white space."""
        if self.empty or not text:
            return None
        low = text.lower()
        spots = [m.span() for m in self.token.finditer(low)]
        ids = tuple([self.ids.get(low[a:b], 0) for a, b in spots])
        best = None
        for end, (n, found) in self.automaton.iter(ids) if ids else ():
            if best is None or found[0] < best:
                held = self.space.sub(" ", low[spots[end - n + 1][0] : spots[end][1]])
                # the same tokens may stand further apart, or closer, than in the surface
                hit = next((f for f in found if f[2] == held), None)
                if hit is not None and (best is None or hit < best):
                    best = hit
        return best


def longest_hits(texts: DataFrame, lexicon: DataFrame, key: str, text: str, part_tokens: int = PART_TOKENS, folder: str | None = None) -> DataFrame:
    """(key, entity_id, region, surface) of texts that hold a surface. lexicon: (surface, entity_id, region, ord), of any size.

    folder: a new one that all executors share, for what is read more than once; without it that is made again.
    """
    own = lexicon.select("surface", "entity_id", "region", F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord"))
    rows = _kept(own.mapInArrow(sieve.hashed, "surface string, entity_id string, region string, ord long, low string, n int, hash long").filter("n > 0"), folder, "lexicon")
    tokens, surfaces, lengths = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.sort_array(F.collect_set("n"))).first()
    kind = texts.schema[key].dataType.simpleString()
    if tokens <= part_tokens:
        automaton = Automaton([(r["surface"], r["entity_id"], r["region"], r["ord"]) for r in rows.collect()])  # part_tokens tokens at most
        return texts.select(key, text).mapInArrow(_walk(automaton), f"{key} {kind}, {HIT}")
    first = _kept(_first_hits(texts, rows, surfaces, lengths, key, text), folder, "first")
    found = first.filter("not open and hit is not null").select(key, "hit.*")
    rest = first.filter("open").select(F.col(key).alias("_townwire_key"))
    if rest.isEmpty():
        return found
    left = texts.select(key, text).join(rest, F.col(key).eqNullSafe(F.col("_townwire_key")), "left_semi")
    return found.unionByName(_in_parts(left, rows, max(-(-tokens // part_tokens), 2 * texts.sparkSession.sparkContext.defaultParallelism), lengths, key, text))


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    if folder is None:
        return df
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _first_hits(texts: DataFrame, rows: DataFrame, surfaces: int, lengths: list[int], key: str, text: str) -> DataFrame:
    """(key, hit, open) of texts with n-grams that pass the filter. open: one that was kept back may be the hit."""
    kind = texts.schema[key].dataType.simpleString()
    passed = texts.select(key, text).mapInArrow(sieve.longest(sieve.build(rows, surfaces), lengths), f"{key} {kind}, _townwire_back int, _townwire_low array<string>")
    sent = passed.select(key, "_townwire_back", F.explode("_townwire_low").alias("_townwire_low"))
    rank = F.struct((-F.length("surface")).alias("n"), "ord", "low", "entity_id", "region")
    # one row for each spelling, so that namesakes don't multiply the texts
    names = rows.groupBy(F.col("low").alias("_townwire_low")).agg(F.min(rank).alias("_townwire_rank"))
    best = F.min("_townwire_rank")  # nulls, of n-grams that aren't held, don't count
    met = sent.join(names, "_townwire_low", "left").groupBy(key).agg(best.alias("_townwire_rank"), F.max("_townwire_back").alias("_townwire_back"))
    hit = F.when(F.col("_townwire_rank").isNotNull(), F.struct("_townwire_rank.entity_id", "_townwire_rank.region", F.col("_townwire_rank.low").alias("surface")))
    return met.select(key, hit.alias("hit"), (F.col("_townwire_back") >= F.coalesce(-F.col("_townwire_rank.n"), F.lit(1))).alias("open"))


def _in_parts(texts: DataFrame, rows: DataFrame, parts: int, lengths: list[int], key: str, text: str) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()
    names = ["_townwire_part", "_townwire_key", "_townwire_ord", "_townwire_strings"]
    led = rows.select("surface", "entity_id", "region", "ord").mapInArrow(_leads, "surface string, entity_id string, region string, ord long, lead long")
    surfaces = led.select(F.pmod("lead", F.lit(parts)).cast("int"), F.lit(None).cast(kind), "ord", F.array("surface", "entity_id", "region")).toDF(*names)
    cut = texts.select(key, text).mapInArrow(_cut(parts, lengths[0], lengths[-1]), f"_townwire_part int, _townwire_key {kind}, _townwire_ord long, _townwire_strings array<string>")
    # a text's stretches have no ord, so they come after the surfaces
    met = surfaces.unionByName(cut).repartition(parts, "_townwire_part").sortWithinPartitions("_townwire_part", F.col("_townwire_ord").asc_nulls_last())
    found = met.mapInArrow(partial(_meet, key), f"{key} {kind}, {HIT}, n long, ord long")
    return found.groupBy(key).agg(F.min_by(F.struct("entity_id", "region", "surface"), F.struct("n", "ord", "surface", "entity_id", "region")).alias("hit")).select(key, "hit.*")


def _lead(tokens: list[str]) -> int:
    """What surfaces and stretches are dealt by: the first two tokens, or the only one."""
    return zlib.crc32(" ".join(tokens[:2]).encode())


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    for batch in batches:
        tokens = [regex.findall(TOKEN, (s or "").lower()) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_lead, tokens), pa.int64())], names=[*batch.schema.names, "lead"])


def stretches(text: str, parts: int, least: int, most: int) -> dict[int, list[str]]:
    """By part, the stretches of a text where surfaces of least to most tokens may begin, the longest first. Such that overlap are joined."""
    import regex

    low = text.lower()
    spots = [m.span() for m in regex.finditer(TOKEN, low)]
    tokens = [low[a:b] for a, b in spots]
    found: dict[int, set[str]] = {}
    runs: dict[int, tuple[int, int]] = {}
    for i, token in enumerate(tokens):
        if least == 1:
            found.setdefault(_lead([token]) % parts, set()).add(token)
        if most > 1 and i + 1 < len(tokens):
            part, end = zlib.crc32(f"{token} {tokens[i + 1]}".encode()) % parts, min(i + most, len(tokens))
            run = runs.get(part)
            if run is not None and i < run[1]:
                runs[part] = run[0], end
                continue
            if run is not None:
                found.setdefault(part, set()).add(low[spots[run[0]][0] : spots[run[1] - 1][1]])
            runs[part] = i, end
    for part, (a, b) in runs.items():
        found.setdefault(part, set()).add(low[spots[a][0] : spots[b - 1][1]])
    return {part: sorted(own, key=len, reverse=True) for part, own in found.items()}


def _cut(parts: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(i, SLICE_ROWS)
                at, part, strings = [], [], []
                for k, text in enumerate(some.column(1).to_pylist()):
                    for p, own in stretches(text, parts, least, most).items() if text else ():
                        at.append(k), part.append(p), strings.append(own)
                columns = [pa.array(part, pa.int32()), some.column(0).take(pa.array(at, pa.int64())), pa.nulls(len(at), pa.int64()), pa.array(strings, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_townwire_part", "_townwire_key", "_townwire_ord", "_townwire_strings"])

    return run


def _meet(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part after the other: its surfaces, which are compiled, then stretches of texts, which walk over them."""
    part, surfaces, automaton = None, [], None
    for batch in batches:
        own, orders = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        at, hits = [], []
        for k, strings in enumerate(batch.column(3).to_pylist()):
            if own[k] != part:
                part, surfaces, automaton = own[k], [], None
            if orders[k] is not None:
                surfaces.append((*strings, orders[k]))
                continue
            if automaton is None:
                automaton, surfaces = Automaton(surfaces), []
            best = None
            for s in strings:
                if best is not None and len(s) < -best[0]:
                    break
                hit = automaton.longest(s)
                if hit is not None and (best is None or hit < best):
                    best = hit
            if best is not None:
                at.append(k), hits.append(best)
        columns = [pa.array([h[k] for h in hits], t) for k, t in ((3, pa.string()), (4, pa.string()), (2, pa.string()), (0, pa.int64()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), *columns], names=[key, "entity_id", "region", "surface", "n", "ord"])


def _walk(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [automaton.longest(t.as_py()) for t in batch.column(1)]
            held = [i for i, h in enumerate(hits) if h is not None]
            columns = [pa.array([hits[i][k] for i in held], pa.string()) for k in (3, 4, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held, pa.int64())), *columns], names=[batch.schema.names[0], "entity_id", "region", "surface"])

    return run
