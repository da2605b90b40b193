"""The rule cascade: ordered decisions with reason codes; the first that holds decides.

Input rows hold text and, where known, alt_text, langs, author_did, author_handle and
soft_prior. Layers, each behind a barrier so that nothing is evaluated twice: the normalised
text, its words, the signals that several rules read, then one lazy ``coalesce(when ...)``
whose conflicts only run for rows that get that far. Rows that an allowlist or an empty text
decides aren't read. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townwire.functions.text import combine, has_language, language_tags, pattern, without_handles
from townwire.operators.lexicon import Lexicon
from townwire.operators.linear import LinearModel, features
from townwire.operators.rules import Reading, RulePack, inline_reading, once, reading, with_pieces

#: Reason codes and prefixes that mark a strong match; an author's history counts these alone.
STRONG_REASONS = ("strong_positive", "strong_positive_over_negative", "town_local", "multi_local_places", "own_term_with_context")
STRONG_PREFIXES = ("entity_local:", "event_local_venue:", "ambiguous_with_context:")
KEEP_REASONS = (*STRONG_REASONS, "allowlist_did", "allowlist_handle", "classifier:local_micro")
KEEP_PREFIXES = (*STRONG_PREFIXES, "soft_prior_ambiguous:", "classifier:ambiguous:")
SIGNALS = "_townwire_"


def _is_in(reason: Column, codes, prefixes) -> Column:
    out = reason.isin(*codes)
    for p in prefixes:
        out = out | reason.startswith(p)
    return F.coalesce(out, F.lit(False))


def is_strong_reason(reason: Column, pack: RulePack | None = None) -> Column:
    own = tuple(with_context for with_context, _ in pack.own_reasons.values()) if pack else ()
    return _is_in(reason, (*STRONG_REASONS, *own), STRONG_PREFIXES)


def is_keep_reason(reason: Column, pack: RulePack | None = None) -> Column:
    own = tuple(with_context for with_context, _ in pack.own_reasons.values()) if pack else ()
    return _is_in(reason, (*KEEP_REASONS, *own), KEEP_PREFIXES)


def reason_class(reason: Column) -> Column:
    return F.get(F.split(reason, ":"), F.lit(0))


def distinct_places(found: Column, excluded: tuple[str, ...]) -> Column:
    """Found places without the excluded ones and without those whose name another one holds."""
    left = F.array_except(found, F.array(*map(F.lit, excluded)).cast("array<string>")) if excluded else found
    return F.filter(left, lambda x: ~F.exists(left, lambda y: (x != y) & F.contains(y, x)))


def chosen_term(found: Column, excluded: tuple[str, ...]) -> Column:
    """The place that the verdict names: not excluded before excluded, then by name."""
    key = lambda x: F.struct(x.isin(*excluded).alias("excluded") if excluded else F.lit(False).alias("excluded"), x.alias("name"))
    return F.array_min(F.transform(found, key))["name"]


def decide(
    posts: DataFrame,
    pack: RulePack,
    lexicon: Lexicon | None = None,
    model: LinearModel | None = None,
    allow_dids: DataFrame | None = None,
    allow_handles: DataFrame | None = None,
    both_priors: bool = False,
) -> DataFrame:
    """posts with matched and reason. allow_dids (did) and allow_handles (handle, lower case) are distinct keys.

    both_priors: soft_prior isn't read; reason holds without it, reason_with_prior with it, and
    matched goes with the former.
    """
    s = SIGNALS
    have = set(posts.columns)
    col = lambda name, default: F.col(name) if name in have else default
    null = F.lit(None).cast("string")
    df = posts
    if allow_dids is not None:
        df = df.join(allow_dids.select(F.col("did").alias(s + "allow_did")).distinct(), df["author_did"] == F.col(s + "allow_did"), "left")
    if allow_handles is not None:
        df = df.join(allow_handles.select(F.col("handle").alias(s + "allow_handle")).distinct(), F.lower(F.col("author_handle")) == F.col(s + "allow_handle"), "left")
    early = F.lit(False)
    if allow_dids is not None:
        early = early | F.col(s + "allow_did").isNotNull()
    if allow_handles is not None:
        early = early | F.col(s + "allow_handle").isNotNull()
    df = df.withColumn(s + "langs", language_tags(col("langs", F.lit(None).cast("array<string>"))))
    df, read = reading(df, combine(col("text", null), col("alt_text", null)), s + "read", early, pack.words() | (lexicon.words() if lexicon else set()))
    df, read = with_pieces(df, read, pack.conflicts.values(), s + "pieces")
    text, langs = read.text, F.col(s + "langs")
    handle = col("author_handle", null)
    own_prior = F.coalesce(col("soft_prior", F.lit(False)), F.lit(False))
    signals = {
        "strong": pack.has("strong", read),
        "hard": pack.has("hard_negative", read),
        "context": in_bare_text(read, lambda r: pack.has("context", r)),
        "anchored": pack.anchored(read),
        "places": in_bare_text(read, lambda r: pack.all_of("ambiguous", r)),
        "event": pack.has("event_cue", read),
        "venue": pack.first_of("venue", read),
    }
    if lexicon is not None:
        signals["entity"] = lexicon.hit(read)
    if model is not None:
        signals["micro"] = _micro(pack, read)
    df = once(df, **{s + k: v for k, v in signals.items()})
    sig = lambda name: F.col(s + name)
    strong, hard, context, anchored, places, event, venue = (sig(n) for n in ("strong", "hard", "context", "anchored", "places", "event", "venue"))
    conflict = lambda name: pack.conflicts[name].condition(read, handle, anchored)
    n_places, term = F.size(places), chosen_term(places, pack.excluded)
    several = distinct_places(places, pack.excluded)
    as_array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")

    rules: list[tuple[Column, Column]] = []
    add = lambda condition, reason: rules.append((condition, F.lit(reason) if isinstance(reason, str) else reason))
    if allow_dids is not None:
        add(F.col(s + "allow_did").isNotNull(), "allowlist_did")
    if allow_handles is not None:
        add(F.col(s + "allow_handle").isNotNull(), "allowlist_handle")
    add(text == "", "empty")
    if pack.language_gate:
        gated, lifted, word = pack.language_gate
        add(has_language(langs, gated) & ~has_language(langs, lifted) & F.contains(read.low, F.lit(word)) & ~pack.has("town_local", read) & ~pack.has("context", read) & ~strong, f"lang_non_local:{gated}")
    if lexicon is not None:
        entity = sig("entity")
        add(entity["region"] == "other", F.concat(F.lit("entity_other:"), entity["entity_id"]))
    add(hard & strong & ~pack.has("blocks_strong", read), "strong_positive_over_negative")
    add(hard, "hard_negative")
    if lexicon is not None:
        for entity_id, name in pack.entity_conflicts.items():
            add((entity["entity_id"] == entity_id) & conflict(name), f"entity_other:{name}")
        add(entity["region"] == "local", F.concat(F.lit("entity_local:"), entity["entity_id"]))
    for name in pack.entity_conflicts.values():
        add(strong & conflict(name), f"entity_other:{name}")
    for name in pack.strong_conflicts:
        add(strong & conflict(name), f"hard_negative:{name}")
    add(strong, "strong_positive")
    if pack.classes.get("town_local"):
        add(pack.has("town_local", read), "town_local")
    add(event & (venue != ""), F.concat(F.lit("event_local_venue:"), venue))
    for c in pack.only_conflicts:
        add((n_places > 0) & (F.size(F.array_except(places, as_array(c.places))) == 0) & conflict(c.conflict), f"hard_negative:{c.conflict}")
    for c in pack.multi_conflicts:
        add((F.size(several) >= 2) & F.arrays_overlap(several, as_array(c.places)) & conflict(c.conflict), f"hard_negative:{c.conflict}")
    add(F.size(several) >= 2, "multi_local_places")
    for c in pack.term_conflicts:
        add((n_places > 0) & term.isin(*c.places) & conflict(c.conflict), f"hard_negative:{c.conflict}")
    # all rules so far hold with and without the prior: for both answers they are read once
    settled = F.coalesce(*(F.when(c, r) for c, r in rules))
    if both_priors:
        df = once(df, **{s + "settled": settled})
        settled = sig("settled")

    def reason(prior: Column) -> Column:
        rules: list[tuple[Column, Column]] = []
        add = lambda condition, reason: rules.append((condition, F.lit(reason) if isinstance(reason, str) else reason))
        kept_by_model = F.lit(False)
        if model is not None:
            own = term.isin(*pack.own_reasons) if pack.own_reasons else F.lit(False)
            f = features(micro=sig("micro"), place=n_places > 0, event=event, venue=venue != "", context=context, own_term=F.coalesce(own, F.lit(False)), prior=prior)
            kept_by_model = (F.size(sig("micro")) > 0) & (model.score(f) >= model.threshold)
        ladder = [(name, with_context, without) for name, (with_context, without) in pack.own_reasons.items()]
        for name, with_context, without in ladder:
            add((n_places > 0) & (term == name) & context, with_context)
        add((n_places > 0) & context, F.concat(F.lit("ambiguous_with_context:"), term))
        add((n_places > 0) & prior, F.concat(F.lit("soft_prior_ambiguous:"), term))
        add((n_places > 0) & kept_by_model, F.concat(F.lit("classifier:ambiguous:"), term))
        for name, with_context, without in ladder:
            add((n_places > 0) & (term == name), without)
        add(n_places > 0, F.concat(F.lit("ambiguous_no_context:"), term))
        add(kept_by_model, "classifier:local_micro")
        return F.coalesce(settled, *(F.when(c, r) for c, r in rules), F.lit("no_match"))

    reasons = {"reason": reason(F.lit(False)), "reason_with_prior": reason(F.lit(True))} if both_priors else {"reason": reason(own_prior)}
    made = once(df, **reasons)
    return made.withColumn("matched", is_keep_reason(F.col("reason"), pack)).select(*posts.columns, "matched", *reasons)


def in_bare_text(read: Reading, look: Callable[[Reading], Column]) -> Column:
    """What look finds in the text without mentions of handles: places and their context aren't read from these."""
    return F.when(F.contains(read.text, F.lit("@")), look(inline_reading(without_handles(read.text)))).otherwise(look(read))


def _micro(pack: RulePack, read: Reading) -> Column:
    """Micro-localities, bylines left out; those whose names collide only beside a hint at the region and without another place."""
    none = F.array().cast("array<string>")

    def matches(name: str) -> Column:
        terms = pack.classes.get(name)
        if not terms or not pack.classes.get("byline"):
            return pack.all_of(name, read)
        scrubbed = F.regexp_replace(read.text, pattern(pack.classes["byline"]), " ")
        found = F.array_distinct(F.transform(F.regexp_extract_all(scrubbed, F.lit(pattern(terms, capture=True)), F.lit(1)), F.lower))
        return F.when(pack.has("byline", read), found).otherwise(pack.all_of(name, read))

    collision = F.when(pack.has("region_hint", read) & ~pack.has("other_place", read), matches("micro_collision")).otherwise(none)
    return F.array_distinct(F.concat(matches("micro"), collision))


def reason_histogram(decided: DataFrame) -> DataFrame:
    """How often each verdict and reason occurs."""
    return decided.groupBy("matched", "reason").agg(F.count("*").alias("n"))
