"""Label curation: candidates, labelled cases, proposals, and set work between key lists."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.functions.text import strip
from townwire.operators.index import first_wins

CONFIDENCES = ("high", "medium", "low")
SPLITS, SIGNALS = ("dev", "holdout"), ("text", "author", "event")


def union_by_priority(sources: Iterable[DataFrame], key: str, *order: str) -> DataFrame:
    """All sources by name; of rows with one key the first source's stays, within a source the first in order."""
    tagged = [df.withColumn("_townwire_source", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first_wins(out, key, "_townwire_source", *(order or (key,))).drop("_townwire_source")


def ordered_distinct(rows: DataFrame, value: str, position: str, ignore_case: bool = False) -> DataFrame:
    """Each value once, as first seen."""
    key = F.lower(F.col(value)) if ignore_case else F.col(value)
    return first_wins(rows.withColumn("_townwire_v", key), "_townwire_v", position).drop("_townwire_v")


def candidates(posts: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Posts with an id and a text that isn't blank, minus known ids; the first of each id."""
    usable = posts.filter((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (strip(F.coalesce("text", F.lit(""))) != ""))
    return first_wins(usable.join(existing.select(key).distinct(), key, "left_anti"), key, "text")


def newest_per(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """Up to n rows per group in the given order; Spark limits each group before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n)


def normalize_cases(raw: DataFrame, strict: bool = False, defaults: dict | None = None) -> DataFrame:
    """Labelled cases with defaults and an error column (null for good rows); strict raises instead. Rows without a label stay, unlabelled.

    Optional fields are null where they are empty; langs keeps the tags that aren't.
    """
    have = set(raw.columns)
    given = {"signal": "text", "bucket": "uncategorized", "split": "dev", "regression": True} | (defaults or {})
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    present = lambda c: F.when(c != "", c)
    named = lambda c: F.coalesce(present(col(c, "string")), F.lit(given[c]))
    split, signal, key = named("split"), named("signal"), strip(F.coalesce(col("id", "string"), F.lit("")))
    # a value of another type than boolean is no flag, whatever a cast would make of it
    kinds = dict(raw.dtypes)
    flag = lambda c: col(c, "boolean") if kinds.get(c) in (None, "boolean", "void") else F.lit(None).cast("boolean")
    odd = lambda c: F.col(c).isNotNull() if kinds.get(c) not in (None, "boolean", "void") else F.lit(False)
    error = F.when(flag("expected").isNotNull() | odd("expected"), F.coalesce(
        F.when(odd("expected"), "expected must be a boolean"),
        F.when(key == "", "labeled row is missing id"),
        F.when(col("text", "string").isNull(), "text is missing"),
        F.when(~signal.isin(*SIGNALS), F.concat(F.lit("unknown signal "), signal)),
        F.when(~split.isin(*SPLITS), F.concat(F.lit("unknown split "), split)),
        F.when(odd("regression"), "regression must be a boolean"),
    ))
    langs = F.filter(col("langs", "array<string>"), lambda x: x.isNotNull() & (x != ""))
    out = raw.select(
        key.alias("id"), col("text", "string").alias("text"), flag("expected").alias("expected"), signal.alias("signal"),
        F.coalesce(present(strip(named("bucket"))), F.lit(given["bucket"])).alias("bucket"), split.alias("split"),
        F.coalesce(flag("regression"), F.lit(given["regression"])).alias("regression"), F.coalesce(flag("soft_prior"), F.lit(False)).alias("soft_prior"),
        *(present(col(c, "string")).alias(c) for c in ("author_did", "author_handle", "alt_text", "note")), F.when(F.size(col("langs", "array<string>")) > 0, langs).alias("langs"), error.alias("error"),
    )
    return out.filter(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).isNull()).otherwise(True)) if strict else out


def merge_cases(existing: DataFrame, incoming: DataFrame, strict: bool = False, defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(all cases, counters): incoming cases are normalised; labelled ones with new ids join the existing ones, which never change.

    Rows with an error are counted as rejected and don't join; strict raises instead.
    """
    rows = normalize_cases(incoming, strict, defaults)
    good = F.col("expected").isNotNull() & F.col("error").isNull()
    known = existing.select(F.col("id").cast("string").alias("id")).distinct()
    fresh = first_wins(rows.filter(good).drop("error").join(known, "id", "left_anti"), "id", "text")
    counted = rows.join(known.withColumn("_townwire_known", F.lit(True)), "id", "left").agg(
        F.count_if(F.col("expected").isNull() & F.col("error").isNull()).alias("skipped_unlabeled"), F.count_if(F.col("error").isNotNull()).alias("rejected"),
        F.count_distinct(F.when(good & F.col("_townwire_known").isNull(), F.col("id"))).alias("added"), F.count_if(good).alias("labelled"),
    )
    counters = counted.select("added", "skipped_unlabeled", (F.col("labelled") - F.col("added")).alias("skipped_existing"), "rejected")
    kept = existing.withColumn("id", F.col("id").cast("string"))
    return kept.unionByName(fresh, allowMissingColumns=True), counters


PROPOSAL = "expected boolean, rationale string, confidence string"


def parse_proposals(responses: DataFrame, column: str = "response") -> DataFrame:
    """Proposals from model answers: fences stripped, the outermost object read, confidence defaults to medium; error says what is wrong."""
    body = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(\{[\s\S]*\})", 1)
    parsed = F.from_json(body, PROPOSAL)
    df = responses.withColumn("p", parsed)
    confidence = F.lower(strip(F.coalesce(F.col("p.confidence"), F.lit("medium"))))
    return df.select(
        *[c for c in responses.columns if c != column], F.col("p.expected").alias("proposed_expected"), strip(F.coalesce("p.rationale", F.lit(""))).alias("proposed_rationale"),
        F.when(confidence.isin(*CONFIDENCES), confidence).otherwise("medium").alias("proposed_confidence"),
        F.when(body == "", "no object").when(F.col("p.expected").isNull(), "expected is not a boolean").alias("error"),
    )


def attach_proposals(rows: DataFrame, proposals: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with their proposals: expected, proposed_by, note; every row with a proposal, or with an answer that was none, waits for a person.

    A proposal with an error leaves expected as it was and says so in the note. Rows without a
    proposal stay as they are.
    """
    joined = rows.join(proposals.withColumn("_townwire_proposed", F.lit(True)), key, "left")
    had = F.coalesce(F.col("note").cast("string"), F.lit("")) if "note" in rows.columns else F.lit("")
    failed, proposed = F.col("error").isNotNull(), F.col("_townwire_proposed").isNotNull()
    said = F.concat(F.lit("llm propose expected="), F.when(F.col("proposed_expected"), "True").otherwise("False"), F.lit(" ("), "proposed_confidence", F.lit("): "), F.coalesce("proposed_rationale", F.lit("")))
    ends = lambda c: F.trim(c, F.lit(" |"))
    both = F.when(strip(had) != "", ends(F.concat(strip(had), F.lit(" | "), said))).otherwise(said)
    note = F.when(~proposed, F.when(had != "", had)).when(failed, ends(F.concat(had, F.lit(" | llm error: "), "error"))).otherwise(both)
    before = F.col("expected") if "expected" in rows.columns else F.lit(None).cast("boolean")
    made = {
        "expected": F.when(proposed & ~failed, F.col("proposed_expected")).otherwise(before), "note": note,
        "proposed_by": F.when(proposed, "llm"), "needs_human_confirm": proposed,
    }
    return joined.withColumns(made).drop("_townwire_proposed")


def key_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side, n): keys that only one list has, with multiplicity."""
    e, a = expected.select(key), actual.select(key)
    missing = e.exceptAll(a).withColumn("side", F.lit("missing"))
    extra = a.exceptAll(e).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra).groupBy(key, "side").agg(F.count("*").alias("n"))


def resolve_handles(handles: DataFrame, profiles: DataFrame) -> DataFrame:
    """(handle, did, dids, status): each listed handle's id; unresolved where no profile has it, ambiguous where several ids do (did is then the least of dids)."""
    p = profiles.select(F.lower("handle").alias("handle"), "did").groupBy("handle").agg(F.min("did").alias("did"), F.count_distinct("did").alias("dids"))
    status = F.when(F.col("did").isNull(), "unresolved").when(F.col("dids") > 1, "ambiguous").otherwise("ok")
    return handles.select(F.lower("handle").alias("handle")).distinct().join(p, "handle", "left").select("handle", "did", F.coalesce("dids", F.lit(0)).alias("dids"), status.alias("status"))


def alignment(handles: DataFrame, dids: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: how many handles and ids are listed, resolved ids that aren't, listed ids that no handle resolves to, and whether the lists agree, one id a handle."""
    listed, found = dids.select(F.col("did").cast("string").alias("did")).distinct(), resolved.filter("status = 'ok'").select(F.col("did").cast("string").alias("did"))
    missing, stale = found.distinct().join(listed, "did", "left_anti"), listed.join(found.distinct(), "did", "left_anti")
    counts = {"handles": handles.select(F.lower("handle")).distinct(), "dids": listed, "ambiguous": resolved.filter("status = 'ambiguous'"), "missing": missing, "stale": stale}
    each = [df.select(F.lit(k).alias("k")) for k, df in counts.items()]
    rows = reduce(DataFrame.unionByName, each).groupBy().agg(*(F.count_if(F.col("k") == k).alias(k) for k in counts))
    return rows.withColumn("aligned", (F.col("handles") == F.col("dids")) & (F.col("missing") + F.col("stale") + F.col("ambiguous") == 0))
