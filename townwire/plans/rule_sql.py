"""Rule packs in DuckDB's SQL: what the cascade decides, spelled out once more for comparison.

Texts are padded so that RE2, which has no look-around, can test the edges of words: p has
two spaces for each one, so that neighbouring words have edges of their own; q has one.
"""

from __future__ import annotations

from collections.abc import Iterable

from townwire.functions.text import WHITE
from townwire.operators.lexicon import Lexicon
from townwire.operators.linear import LinearModel
from townwire.operators.rules import Conflict, RulePack

EDGE = r"[^\p{L}\p{N}_]"
#: Characters that strip() takes off the ends of texts.
WHITE_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE) + ")"


def alternatives(terms: Iterable[str]) -> str:
    return "(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")"


def has(terms: Iterable[str], of: str = "q") -> str:
    terms = list(terms)
    return f"regexp_matches({of}, '{EDGE}{alternatives(terms)}{EDGE}')" if terms else "false"


def found(terms: Iterable[str], of: str = "q") -> str:
    """The list of terms that occur."""
    parts = ", ".join(f"case when regexp_matches({of}, '{EDGE}{t}{EDGE}') then '{t}' end" for t in sorted(terms))
    return f"list_filter([{parts}], lambda t: t is not null)" if parts else "[]::varchar[]"


def near(a: Iterable[str], b: Iterable[str], window: int) -> str:
    one = lambda x, y: f"regexp_matches(q, '{EDGE}{alternatives(x)}(?:{EDGE}|{EDGE}[\\s\\S]{{0,{window - 2}}}{EDGE}){alternatives(y)}{EDGE}')"
    return f"({one(a, b)} or {one(b, a)})"


def conflict(c: Conflict) -> str:
    hits = [near(c.trigger, c.cues, c.window)] if c.cues else []
    hits += [has(c.phrases)] if c.phrases else []
    hits += [f"({has(c.handles, 'hq')} and {has(c.trigger)})"] if c.handles else []
    return f"(({' or '.join(hits)})" + (f" and not {has(c.escape)}" if c.escape else "") + (" and not anchored" if c.escape_context else "") + ")"


def without_handles(of: str) -> str:
    """Mentions as one space; the character before one, which must not be part of an address, stays."""
    return rf"regexp_replace({of}, '(^|[^\p{{L}}\p{{N}}_.+-])@[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.-]*', '\1 ', 'g')"


def quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def signals(pack: RulePack, lexicon: Lexicon, src: str) -> str:
    """CTEs from src (uri, text, alt_text, langs, author_handle and more) to sig, with all that the cascade reads."""
    c = pack.classes
    scrubbed = rf"regexp_replace(p, '({EDGE}){alternatives(t.replace(' ', '  ') for t in c['byline'])}({EDGE})', '\1 \2', 'g')"
    best = "case " + " ".join(f"when {has([s.surface])} then {i}" for i, s in enumerate(lexicon.surfaces)) + " end"
    surfaces = ", ".join(f"({i}, '{s.surface}', '{s.entity_id}', '{s.region}')" for i, s in enumerate(lexicon.surfaces))
    return rf"""
    lex(ord, surface, entity_id, region) as (values {surfaces}),
    norm as (select *, trim(regexp_replace(coalesce(text, '') || case when coalesce(alt_text, '') <> '' then ' ' || alt_text else '' end, '\s+', ' ', 'g')) as t from {src}),
    padded as (select *, ' ' || lower(t) || ' ' as q, ' ' || replace(lower(t), ' ', '  ') || ' ' as p, ' ' || lower(coalesce(author_handle, '')) || ' ' as hq, ' ' || lower({without_handles('t')}) || ' ' as bq from norm),
    hit as (select *, {scrubbed} as scr, {best} as best from padded),
    read as materialized (select hit.*, entity_id, region from hit left join lex on lex.ord = best),
    sig0 as materialized (select *, {has(c["strong"])} as strong, {has(c["hard_negative"])} as hard, {has(c["context"], "bq")} as context, {has(c["context"])} as anywhere, {has(c.get("anchored_context", c["context"]))} as anchored, {has(c["blocks_strong"])} as blocks, {has(c["town_local"])} as town,
      {has(c["event_cue"])} as ev, coalesce({_first_venue(c["venue"])}, '') as venue, {found(c["ambiguous"], "bq")} as places,
      list_distinct({found(c["micro"], "scr")} || case when {has(c["region_hint"])} and not {has(c["other_place"])} then {found(c["micro_collision"], "scr")} else []::varchar[] end) as micro,
      list_contains(langs, 'fr') as fr, list_contains(langs, 'en') as en from read),
    sig as materialized (select *, list_filter(list_filter(places, lambda x: x not in ({quoted(pack.excluded)})), lambda x: len(list_filter(places, lambda y: y <> x and contains(y, x) and y not in ({quoted(pack.excluded)}))) = 0) as several,
      substr(list_min(list_transform(places, lambda x: case when x in ({quoted(pack.excluded)}) then '1' else '0' end || x)), 2) as term from sig0)"""


def _first_venue(terms: Iterable[str]) -> str:
    """The venue that comes first: of those at one place the longest."""
    return f"nullif(replace(regexp_extract(p, '{EDGE}(' || '{alternatives(t.replace(' ', '  ') for t in terms)}' || '){EDGE}', 1), '  ', ' '), '')"


def features(pack: RulePack, prior: str) -> dict[str, str]:
    n = "least(len(micro), 3)"
    flag = lambda x: f"({x})::int"
    return {
        "micro_count": n, "has_micro": flag("len(micro) > 0"), "has_place": flag("len(places) > 0"), "event_cue": flag("ev"), "venue": flag("venue <> ''"), "context": flag("context"),
        "own_term": f"coalesce((term in ({quoted(pack.own_reasons)}))::int, 0)", "prior": flag(prior), "event_and_micro": flag("ev and len(micro) > 0"), "event_and_venue": flag("ev and venue <> ''"),
        "venue_without_cue": flag("venue <> '' and not ev"), "no_place": flag("len(places) = 0"),
    }


def score(pack: RulePack, model: LinearModel, prior: str) -> str:
    return "(" + " + ".join([str(model.weights["bias"]), *(f"{model.weights[k]} * {x}" for k, x in features(pack, prior).items())]) + ")::double"


def reason(pack: RulePack, model: LinearModel, prior: str, dids: Iterable[str] = (), handles: Iterable[str] = ()) -> str:
    """The cascade as one case expression over sig."""
    gated, lifted, word = pack.language_gate
    whens = []
    add = lambda condition, value: whens.append(f"when {condition} then {value}")
    if dids:
        add(f"author_did in ({quoted(dids)})", "'allowlist_did'")
    if handles:
        add(f"lower(author_handle) in ({quoted(handles)})", "'allowlist_handle'")
    add("t = ''", "'empty'")
    add(f"{gated} and not {lifted} and contains(q, '{word}') and not town and not anywhere and not strong", f"'lang_non_local:{gated}'")
    add("region = 'other'", "'entity_other:' || entity_id")
    add("hard and strong and not blocks", "'strong_positive_over_negative'")
    add("hard", "'hard_negative'")
    for entity, name in pack.entity_conflicts.items():
        add(f"entity_id = '{entity}' and {conflict(pack.conflicts[name])}", f"'entity_other:{name}'")
    add("region = 'local'", "'entity_local:' || entity_id")
    for name in pack.entity_conflicts.values():
        add(f"strong and {conflict(pack.conflicts[name])}", f"'entity_other:{name}'")
    for name in pack.strong_conflicts:
        add(f"strong and {conflict(pack.conflicts[name])}", f"'hard_negative:{name}'")
    add("strong", "'strong_positive'")
    add("town", "'town_local'")
    add("ev and venue <> ''", "'event_local_venue:' || venue")
    for x in pack.only_conflicts:
        add(f"len(places) > 0 and len(list_filter(places, lambda x: x not in ({quoted(x.places)}))) = 0 and {conflict(pack.conflicts[x.conflict])}", f"'hard_negative:{x.conflict}'")
    for x in pack.multi_conflicts:
        add(f"len(several) >= 2 and list_has_any(several, [{quoted(x.places)}]) and {conflict(pack.conflicts[x.conflict])}", f"'hard_negative:{x.conflict}'")
    add("len(several) >= 2", "'multi_local_places'")
    for x in pack.term_conflicts:
        add(f"term in ({quoted(x.places)}) and {conflict(pack.conflicts[x.conflict])}", f"'hard_negative:{x.conflict}'")
    kept = f"len(micro) > 0 and {score(pack, model, prior)} >= {model.threshold}"
    for name, (with_context, _) in pack.own_reasons.items():
        add(f"term = '{name}' and context", f"'{with_context}'")
    add("len(places) > 0 and context", "'ambiguous_with_context:' || term")
    add(f"len(places) > 0 and {prior}", "'soft_prior_ambiguous:' || term")
    add(f"len(places) > 0 and {kept}", "'classifier:ambiguous:' || term")
    for name, (_, without) in pack.own_reasons.items():
        add(f"term = '{name}'", f"'{without}'")
    add("len(places) > 0", "'ambiguous_no_context:' || term")
    add(kept, "'classifier:local_micro'")
    return "case " + " ".join(whens) + " else 'no_match' end"


def matches(pack: RulePack, codes: Iterable[str], prefixes: Iterable[str], column: str = "reason") -> str:
    own = [with_context for with_context, _ in pack.own_reasons.values()]
    return f"({column} in ({quoted([*codes, *own])}) or " + " or ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"
