"""Alt text of post embeds of any depth, read as VARIANT.

An embed may hold media and a quoted record, which may hold an embed again. A row's embed is
walked with a list of what is still to read, one embed a step, in a fold over as many steps as
the embed can hold objects: depth has no limit, and nothing leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townwire.functions.text import clip, join_present

#: Renderings of values that count as missing where a quoted record should be.
HOLLOW = ("", "{}", "[]", "false", "0")


def embed_type() -> T.DataType:
    """Embeds stay VARIANT until their texts are read."""
    return T.VariantType()


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _own(embed: Column) -> Column:
    """An embed's image alts, title and description, each clipped; '' or null for what is missing."""
    alts = F.transform(F.coalesce(_at(embed, "images", "array<variant>"), F.array().cast("array<variant>")), lambda i: clip(_at(i, "alt", "string")))
    return F.concat(alts, F.array(clip(_at(embed, "external.title", "string")), clip(_at(embed, "external.description", "string"))))


def _inner(embed: Column) -> Column:
    """What an embed holds, in reading order: its media, then the quoted record's text and embed. Of a record that is missing or empty the value is read."""
    record = _at(embed, "record.record", "string")
    quotes = record.isNotNull() & ~record.isin(*HOLLOW)
    quoted = lambda name, kind: F.when(quotes, _at(embed, f"record.record.{name}", kind)).otherwise(_at(embed, f"record.value.{name}", kind))
    parts = F.array(
        F.struct(F.lit(None).cast("string").alias("text"), _at(embed, "media").alias("embed")),
        F.struct(quoted("text", "string").alias("text"), quoted("embed", "variant").alias("embed")),
    )
    return F.filter(parts, lambda p: p["text"].isNotNull() | p["embed"].isNotNull())


def alt_text(embed: Column) -> Column:
    """Image alts, link-card title and description, media, quoted text and its embed, each clipped, joined by a space; '' for none.

    embed is VARIANT. Null, empty embeds and those of other kinds (numbers, strings, lists) give
    ''; a part of an unexpected kind is left out, the rest is read.
    """
    start = F.struct(F.array().cast("array<string>").alias("read"), F.array(F.struct(F.lit(None).cast("string").alias("text"), embed.alias("embed"))).alias("ahead"))

    def step(done: Column, _: Column) -> Column:
        head = F.get(done["ahead"], F.lit(0))
        read = F.concat(done["read"], F.array(clip(head["text"])), _own(head["embed"]))
        ahead = F.concat(_inner(head["embed"]), F.slice(done["ahead"], F.lit(2), F.size(done["ahead"])))
        return F.when(F.size(done["ahead"]) == 0, done).otherwise(F.struct(read.alias("read"), ahead.alias("ahead")))

    # every embed but the first is a value of an object, or comes with a quoted record that is
    steps = F.sequence(F.lit(0), F.regexp_count(embed.cast("string"), F.lit(r":\s*\{")))
    return F.coalesce(join_present(F.aggregate(steps, start, step, lambda done: done["read"])), F.lit(""))


def merged_alt_text(*alts: Column) -> Column:
    """Several renderings of alt text, in order, each once."""
    return F.array_join(F.array_distinct(F.filter(F.array(*alts), lambda x: x.isNotNull() & (x != ""))), " ")
