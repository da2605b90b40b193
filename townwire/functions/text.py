"""Text expressions. All are built-in column functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of a word: no letter, digit or underscore. `\\b` counts combining marks as word characters, these don't.
LEFT_EDGE, RIGHT_EDGE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMBED_CHARS, PREVIEW_CHARS = 320, 160
#: All that counts as white space at the ends of a text: Unicode's white space and the four separators of ASCII.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.trim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    """Runs of white space, no-break spaces too, become one space; ends are trimmed; null is ''."""
    # a lone space isn't matched: most texts stay as they are and aren't copied
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(?:[\s\x1c-\x1f&&[^\x20]][\s\x1c-\x1f]*|\x20[\s\x1c-\x1f]+)", " "))


def clip(c: Column, chars: int = EMBED_CHARS) -> Column:
    """Stripped, cut to so many characters, stripped again at the end; null is ''."""
    return F.rtrim(F.substring(strip(F.coalesce(c, F.lit(""))), 1, chars), F.lit(WHITE))


def join_present(parts: Column) -> Column:
    """Joins an array's strings that aren't null or empty by one space."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def combine(text: Column, alt: Column) -> Column:
    """Text and alt text as one normalised string."""
    return normalize(F.concat_ws(" ", text, F.when(F.coalesce(alt, F.lit("")) != "", alt)))


def language_tags(langs: Column) -> Column:
    """Stripped, lower-cased, underscores to hyphens, empty ones dropped; null is []."""
    cleaned = F.transform(langs, lambda x: F.replace(F.lower(strip(x)), F.lit("_"), F.lit("-")))
    return F.coalesce(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def has_language(tags: Column, prefix: str) -> Column:
    """Is the language itself, or one of its regional tags, among normalised tags?"""
    return F.exists(tags, lambda x: (x == prefix) | x.startswith(prefix + "-"))


def without_handles(c: Column) -> Column:
    """Mentions (@name) removed; the local part of an e-mail address stays."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_.+-])@[\p{L}\p{N}_][\p{L}\p{N}_.-]*", " ")


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(F.translate(F.coalesce(c, F.lit("")), "\n\r", "  "), 1, chars)


def surface_form(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def pattern(terms: Iterable[str], capture: bool = False) -> str:
    """One alternation over literal terms with word edges, longest first; a space matches any one white space character."""
    special = set("\\.^$|?*+()[]{}-#&~")
    quoted = ["".join("\\" + ch if ch in special else r"[\s\x{A0}]" if ch == " " else ch for ch in t) for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    edge = lambda t, i, e: e if (t[i].isalnum() or t[i] == "_") else ""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    # looking back is slow: only where a term's first letter stands
    guarded = [edge(t, 0, f"(?={t[0]}){LEFT_EDGE}") + q + edge(t, -1, RIGHT_EDGE) for t, q in zip(ordered, quoted)]
    return "(?iu)" + ("(" if capture else "(?:") + "|".join(guarded) + ")"

