"""Rule packs: term tables that become predicate columns.

A pack is data: classes of literal terms and conflict rules. A text is read once, into its
lower-case form and its distinct words: terms that are one word are looked up among these,
others are looked for as plain substrings, and only where one occurs, but not between
spaces, does a regular expression, compiled once by each task, test the edges of its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townwire.functions.text import LEFT_EDGE, RIGHT_EDGE, pattern


@dataclass(frozen=True)
class Reading:
    """A normalised text, its lower-case form between two spaces, its distinct words in order of appearance, and, where windows are looked at, its pieces around their words."""

    text: Column
    low: Column
    words: Column
    pieces: Column | None = None


def reading(df: DataFrame, text: Column, name: str = "_townwire_read", skip: Column | None = None, among: Iterable[str] | None = None) -> tuple[DataFrame, Reading]:
    """df with a normalised text read once. Where skip holds, nothing is read. among: all words that will be looked up; those that begin otherwise are dropped at once, so that each look-up meets a few words instead of the whole text's."""
    df = once(df, **{f"{name}_text": text})
    own = F.col(f"{name}_text")
    low = F.concat(F.lit(" "), F.lower(own), F.lit(" "))
    low = low if skip is None else F.when(skip, F.lit("")).otherwise(low)
    df = once(df, **{f"{name}_low": low})
    words = F.split(F.col(f"{name}_low"), NOT_WORD)
    if among is not None:
        begins = sorted({w[:BEGINS] for w in among})
        words = F.filter(words, lambda w: F.substring(w, 1, BEGINS).isin(*begins))
    df = once(df, **{f"{name}_words": F.array_distinct(words)})
    return df, Reading(own, F.col(f"{name}_low"), F.col(f"{name}_words"))


NOT_WORD = r"[^\p{L}\p{N}_]+"
#: So many first letters tell whether a word may be one that is looked up.
BEGINS = 4


def split_terms(terms: Iterable[str]) -> tuple[list[str], list[str]]:
    """Terms that are one word, in lower case, and all others."""
    one = lambda t: all(ch.isalnum() or ch == "_" for ch in t)
    terms = sorted(set(terms))
    return [t.lower() for t in terms if one(t)], [t for t in terms if not one(t)]


def inline_reading(text: Column) -> Reading:
    """A reading without a barrier, for expressions that few rows reach."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return Reading(text, low, F.array_distinct(F.split(low, NOT_WORD)))


def literals(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def either(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def may_hold(terms: Iterable[str], read: Reading) -> Column:
    """Does any term occur as a word or a substring? True wherever has_terms is."""
    words, others = split_terms(terms)
    return either([*([F.arrays_overlap(read.words, literals(words))] if words else []), *(F.contains(read.low, F.lit(t.lower())) for t in others)])


def has_terms(terms: Iterable[str], read: Reading) -> Column:
    """Does any term occur between edges of words?"""
    words, others = split_terms(terms)
    parts = [F.arrays_overlap(read.words, literals(words))] if words else []
    if others:
        spaced = either(F.contains(read.low, F.lit(f" {t.lower()} ")) for t in others)
        parts.append(may_hold(others, read) & (spaced | read.text.rlike(pattern(others))))
    return either(parts)


#: Parts the pieces of a text. A text that holds this character reads as if it held a space.
MARK = "\ue000"


def pieces(words: Iterable[str], read: Reading) -> Column:
    """The lower-case text cut at these words, in one pass: text, word, text, word, ... text."""
    words = set(words)
    found = f"(?=[{''.join(sorted({w[0] for w in words}))}]){LEFT_EDGE}({'|'.join(sorted(words, key=lambda w: (-len(w), w)))}){RIGHT_EDGE}"
    return F.split(F.regexp_replace(F.translate(read.low, MARK, " "), found, f"{MARK}$1{MARK}"), MARK)


def close(cut: Column, a: Iterable[str], b: Iterable[str], window: int) -> Column:
    """Do words of a and of b stand within so many characters? One walk over pieces, which keeps how far back the last of each kind ended."""
    far, one = F.lit(1 << 40), [sorted(set(a)), sorted(set(b))]

    def step(at: Column, piece: Column) -> Column:
        is_a, is_b = (at["word"] & piece.isin(*own) for own in one)
        hit = at["hit"] | (is_b & (at["a"] <= window)) | (is_a & (at["b"] <= window))
        back = lambda is_, gap: F.when(is_, F.lit(0).cast("long")).otherwise(gap + F.char_length(piece))
        return F.struct(back(is_a, at["a"]).alias("a"), back(is_b, at["b"]).alias("b"), hit.alias("hit"), (~at["word"]).alias("word"))

    start = F.struct(far.alias("a"), far.alias("b"), F.lit(False).alias("hit"), F.lit(False).alias("word"))
    return F.aggregate(cut, start, step, lambda at: at["hit"])


def spans(terms: Iterable[str], read: Reading) -> Column:
    """Where these terms stand in the lower-case text, as array of (first, end); each is looked for alone, so that terms that overlap don't hide each other."""
    out = []
    for t in sorted(set(terms)):
        body = pattern([t.lower()], capture=True).removeprefix("(?iu)")
        cut = F.split(F.regexp_replace(F.translate(read.low, MARK, " "), body, f"{MARK}$1{MARK}"), MARK)
        none = F.array().cast("array<struct<first:long,end:long>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("word"), none.alias("found"))

        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.char_length(piece)
            found = F.when(acc["word"], F.array_append(acc["found"], F.struct(acc["at"].alias("first"), end.alias("end")))).otherwise(acc["found"])
            return F.struct(end.alias("at"), (~acc["word"]).alias("word"), found.alias("found"))

        out.append(F.aggregate(cut, start, step, lambda acc: acc["found"]))
    return F.concat(*out)


def window_words(conflicts: Iterable[Conflict]) -> list[str]:
    """The words of all windows that only have terms of one word."""
    own = [(*c.trigger, *c.cues) for c in conflicts if c.cues]
    return sorted({w for terms in own if not split_terms(terms)[1] for w in split_terms(terms)[0]})


def with_pieces(df: DataFrame, read: Reading, conflicts: Iterable[Conflict], name: str = "_townwire_pieces") -> tuple[DataFrame, Reading]:
    """df with a text's pieces around the words of all windows, cut once and only where a window may hold its trigger and its cue."""
    conflicts = [c for c in conflicts if c.cues]
    words = window_words(conflicts)
    if not words:
        return df, read
    some = either(may_hold(c.trigger, read) & may_hold(c.cues, read) for c in conflicts)
    df = once(df, **{name: F.when(some, pieces(words, read)).otherwise(F.array().cast("array<string>"))})
    return df, replace(read, pieces=F.col(name))


@dataclass(frozen=True)
class Conflict:
    """A place name meant elsewhere: a trigger with a cue within a window, a fixed phrase, or a telling handle; unless an escape matches."""

    name: str
    trigger: tuple[str, ...]
    cues: tuple[str, ...] = ()
    window: int = 160
    phrases: tuple[str, ...] = ()
    handles: tuple[str, ...] = ()
    escape: tuple[str, ...] = ()
    escape_context: bool = False

    def condition(self, read: Reading, handle: Column, context: Column) -> Column:
        """context: does the text hold what RulePack.anchored looks for?"""
        hits = []
        if self.cues:
            hits.append(has_terms(self.trigger, read) & has_terms(self.cues, read) & self.in_window(read))
        if self.phrases:
            hits.append(has_terms(self.phrases, read))
        if self.handles:
            hits.append(F.coalesce(handle, F.lit("")).rlike("(?iu)(?:" + "|".join(pattern([h]).removeprefix("(?iu)") for h in self.handles) + ")") & has_terms(self.trigger, read))
        if not hits:
            raise ValueError(f"conflict {self.name} has no cue, phrase or handle")
        out = either(hits)
        if self.escape:
            out = out & ~has_terms(self.escape, read)
        return out & ~context if self.escape_context else out


    def in_window(self, read: Reading) -> Column:
        """Do a trigger and a cue stand within the window, in either order?"""
        (a, a_more), (b, b_more) = split_terms(self.trigger), split_terms(self.cues)
        if not a_more and not b_more:
            return close(pieces([*a, *b], read) if read.pieces is None else read.pieces, a, b, self.window)
        one, other = spans(self.trigger, read), spans(self.cues, read)
        apart = lambda x, y: (y["first"] >= x["end"]) & (y["first"] - x["end"] <= self.window)
        return F.exists(one, lambda x: F.exists(other, lambda y: apart(x, y) | apart(y, x)))


@dataclass(frozen=True)
class SetConflict:
    """A conflict that decides when the distinct places are among, or meet, a set."""

    conflict: str
    places: tuple[str, ...]


@dataclass(frozen=True)
class RulePack:
    """Classes: strong, ambiguous, context, anchored_context, hard_negative, blocks_strong, town_local, event_cue, venue, micro, micro_collision, region_hint, byline, other_place."""

    classes: dict[str, tuple[str, ...]]
    conflicts: dict[str, Conflict] = field(default_factory=dict)
    #: Conflict by local entity id, tried before an entity or a strong phrase keeps a text.
    entity_conflicts: dict[str, str] = field(default_factory=dict)
    strong_conflicts: tuple[str, ...] = ()
    #: Decide when the places are a subset of the set; when two or more meet it; when the chosen term is in it.
    only_conflicts: tuple[SetConflict, ...] = ()
    multi_conflicts: tuple[SetConflict, ...] = ()
    term_conflicts: tuple[SetConflict, ...] = ()
    #: Places that don't count towards two distinct ones.
    excluded: tuple[str, ...] = ()
    #: Terms with reasons of their own: term -> (reason with context, reason without).
    own_reasons: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: (language, language that lifts the gate, word) of the language gate.
    language_gate: tuple[str, str, str] | None = None

    def has(self, name: str, read: Reading) -> Column:
        return has_terms(self.classes.get(name, ()), read)

    def words(self) -> set[str]:
        """All terms of one word that any class or conflict looks up."""
        own = (c.trigger + c.cues + c.phrases + c.escape for c in self.conflicts.values())
        return {w for terms in (*self.classes.values(), *own) for w in split_terms(terms)[0]}

    def anchored(self, read: Reading) -> Column:
        """The context that lifts a conflict: a class of its own, or the context class where a pack has none."""
        return self.has("anchored_context" if "anchored_context" in self.classes else "context", read)

    def all_of(self, name: str, read: Reading) -> Column:
        """All matches of a class, lower-cased and distinct, in order of appearance; of terms that overlap the longest first."""
        terms = self.classes.get(name, ())
        words, others = split_terms(terms)
        alone = F.array_intersect(read.words, literals(words))
        if not others:
            return alone
        found = F.array_distinct(F.transform(F.regexp_extract_all(read.text, F.lit(pattern(terms, capture=True)), F.lit(1)), F.lower))
        return F.when(may_hold(others, read), found).otherwise(alone)

    def first_of(self, name: str, read: Reading) -> Column:
        terms = self.classes.get(name, ())
        words, others = split_terms(terms)
        alone = F.coalesce(F.get(F.array_intersect(read.words, literals(words)), F.lit(0)), F.lit(""))
        return F.when(may_hold(others, read), F.lower(F.regexp_extract(read.text, pattern(terms, capture=True), 1))).otherwise(alone) if others else alone


def load_pack(path: str | Path) -> RulePack:
    """A pack from JSON; the keys are the fields of RulePack."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    tup = lambda x: tuple(x)
    sets = lambda name: tuple(SetConflict(c["conflict"], tup(c["places"])) for c in raw.get(name, ()))
    conflicts = {c["name"]: Conflict(**{k: tup(v) if isinstance(v, list) else v for k, v in c.items()}) for c in raw.get("conflicts", ())}
    return RulePack(
        classes={k: tup(v) for k, v in raw["classes"].items()},
        conflicts=conflicts,
        entity_conflicts=raw.get("entity_conflicts", {}),
        strong_conflicts=tup(raw.get("strong_conflicts", ())),
        only_conflicts=sets("only_conflicts"),
        multi_conflicts=sets("multi_conflicts"),
        term_conflicts=sets("term_conflicts"),
        excluded=tup(raw.get("excluded", ())),
        own_reasons={k: tup(v) for k, v in raw.get("own_reasons", {}).items()},
        language_gate=tup(raw["language_gate"]) if raw.get("language_gate") else None,
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions can't be merged with, so that each is evaluated once.

    The one-element ``inline`` is a generator: neither project collapsing nor filter push-down
    copies what is below it. It only hands on what a projection has made: higher-order functions
    aren't generated code, and a generator that holds one interprets all its expressions, while
    a projection interprets that one alone.
    """
    made = df.select("*", *(c.alias(f"_townwire_made_{name}") for name, c in columns.items()))
    handed = F.inline(F.array(F.struct(*(F.col(f"_townwire_made_{name}").alias(name) for name in columns))))
    return made.select("*", handed).drop(*(f"_townwire_made_{name}" for name in columns))
