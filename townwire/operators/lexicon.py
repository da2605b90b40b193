"""Lexicon lookup: the longest surface that a text holds decides; ties go to the order of the file."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townwire.functions.text import pattern
from townwire.operators.rules import Reading, has_terms, literals, may_hold, once, split_terms

REGIONS = ("local", "other")
#: Surfaces of several words that are tested one by one.
ONE_BY_ONE = 100
#: Surfaces of a lexicon that is sent to all tasks.
SENT = 100_000
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


@dataclass(frozen=True)
class Surface:
    surface: str
    entity_id: str
    region: str


@dataclass(frozen=True)
class Lexicon:
    """Surfaces, longest first; equal lengths keep the file's order."""

    surfaces: tuple[Surface, ...]

    @staticmethod
    def of(entities: list[dict]) -> Lexicon:
        """From [{id, region, surfaces}]; an unknown region is an error."""
        rows = []
        for e in entities:
            if e["region"] not in REGIONS:
                raise ValueError(f"entity {e['id']!r} has region {e['region']!r}, not one of {REGIONS}")
            rows += [Surface(s.lower().strip(), e["id"], e["region"]) for s in e["surfaces"] if s.strip()]
        return Lexicon(tuple(sorted(rows, key=lambda s: -len(s.surface))))

    @staticmethod
    def load(path: str | Path) -> Lexicon:
        return Lexicon.of(json.loads(Path(path).read_text(encoding="utf-8"))["entities"])

    def words(self) -> set[str]:
        """All surfaces of one word."""
        return set(split_terms(s.surface for s in self.surfaces)[0])

    def hit(self, text: Reading) -> Column:
        """struct(entity_id, region, surface) of a text's longest hit, or null. Narrow, for lexicons of some thousand surfaces.

        Surfaces of one word are looked up among the text's words. Others are tested one by
        one, the longest first, up to the first hit, which mostly takes a plain substring
        search; where they are many, one alternation is looked for at every position without
        consuming it, so that overlapping surfaces don't hide each other.
        """
        first = {}
        for rank, s in enumerate(self.surfaces):
            first.setdefault(s.surface, rank)
        if not first:
            return F.lit(None).cast("struct<entity_id:string,region:string,surface:string>")
        words, others = split_terms(first)
        ranks = F.create_map(*(x for name, rank in first.items() for x in (F.lit(name), F.lit(rank))))
        table = F.array(*(F.struct(F.lit(s.entity_id).alias("entity_id"), F.lit(s.region).alias("region"), F.lit(s.surface).alias("surface")) for s in self.surfaces))
        parts = [F.array_min(F.transform(F.array_intersect(text.words, literals(words)), lambda h: F.element_at(ranks, h)))] if words else []
        if 0 < len(others) <= ONE_BY_ONE:
            parts.append(F.coalesce(*(F.when(has_terms([t], text), first[t]) for t in sorted(others, key=first.__getitem__))))
        elif others:
            body = pattern(others, capture=True).removeprefix("(?iu)")
            hits = F.regexp_extract_all(text.text, F.lit(f"(?iu)(?={body})"), F.lit(1))
            parts.append(F.when(may_hold(others, text), F.array_min(F.transform(hits, lambda h: F.element_at(ranks, F.lower(h))))))
        best = F.least(*parts) if len(parts) > 1 else parts[0]
        return F.get(table, best)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.surface, s.entity_id, s.region, i) for i, s in enumerate(self.surfaces)], "surface string, entity_id string, region string, ord int")


def join_hits(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """The same for lexicons of any size: token n-grams joined on the surface, then one row per key with its longest hit.

    lexicon: (surface, entity_id, region, ord). The n-grams have all numbers of tokens that its
    surfaces have, which one aggregate finds. A lexicon of up to SENT surfaces is broadcast, so
    that only hits are shuffled; a larger one meets the n-grams in a shuffle. Meant for short posts; long texts go
    through ``Lexicon.hit``, which makes no rows.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))
    parts = F.regexp_extract_all("surface", F.lit(TOKEN), F.lit(0))
    counts = lexicon.groupBy(F.size(parts).alias("n")).count().filter("n > 0").collect()  # as many as there are lengths
    lengths = sorted(r["n"] for r in counts) or [1]
    # a barrier, as the tokens would else be made again for every n-gram
    cut = once(texts.select(key, text), _townwire_tokens=tokens)
    grams = cut.select(key, F.explode(F.array_distinct(F.flatten(F.transform(F.lit(lengths), lambda n: _grams(F.col("_townwire_tokens"), n))))).alias("gram"))
    spaced = lexicon.withColumn("gram", F.array_join(parts, " ")).withColumn("len", F.length("surface"))
    if sum(r["count"] for r in counts) <= SENT:
        spaced = F.broadcast(spaced)
    best = F.max_by(F.struct("entity_id", "region", "surface"), F.struct("len", -F.col("ord")))
    return grams.join(spaced, "gram").groupBy(key).agg(best.alias("hit")).select(key, "hit.*")


def _grams(tokens: Column, n: Column) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
