"""The cascade against sentences of our own and against a sequential reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from townwire.operators import cascade
from townwire.operators.lexicon import Lexicon, join_hits
from townwire.operators.linear import LinearModel
from townwire.operators.rules import Conflict, RulePack, SetConflict, reading

PACK = RulePack(
    classes={
        "strong": ("brookvale council",), "ambiguous": ("milford", "east milford", "hartley", "dunmore"), "context": ("upstate", "tri county"), "hard_negative": ("horoscope",), "blocks_strong": ("giveaway",),
        "town_local": ("hartley green",), "event_cue": ("tonight", "tickets"), "venue": ("the lantern",), "micro": ("mill lane", "orchard row"), "micro_collision": ("river street",), "region_hint": ("brookvale",), "other_place": ("savannah",),
    },
    conflicts={
        "overseas": Conflict("overseas", ("milford", "dunmore"), cues=("overseas", "ferry"), window=20, escape=("tri county",)),
        "county": Conflict("county", ("brook county", "brookvale council"), cues=("wyoming",), window=240),
        "handle": Conflict("handle", ("hartley",), handles=("hartleyfc",), phrases=("hartley fc",), escape_context=True),
    },
    entity_conflicts={"county": "county"}, strong_conflicts=("overseas",),
    only_conflicts=(SetConflict("overseas", ("dunmore",)),), multi_conflicts=(SetConflict("overseas", ("dunmore",)),), term_conflicts=(SetConflict("handle", ("hartley",)),),
    excluded=("dunmore",), own_reasons={"milford": ("milford_with_context", "bare_milford")}, language_gate=("fr", "en", "milford"),
)
LEXICON = Lexicon.of([{"id": "county", "region": "local", "surfaces": ["Brook County"]}, {"id": "far", "region": "other", "surfaces": ["lake brook county", "far town"]}])
MODEL = LinearModel({"bias": -1.0, "micro_count": 0.7, "has_place": 0.5, "event_and_micro": 1.0}, threshold=0.0)


def verdict(spark, text, model=None, **more):
    kinds = {"langs": "array<string>", "author_did": "string", "author_handle": "string", "alt_text": "string", "soft_prior": "boolean"}
    df = spark.createDataFrame([(text, *more.values())], ", ".join(["text string", *(f"{k} {kinds[k]}" for k in more)]))
    row = cascade.decide(df, PACK, LEXICON, model).first()
    return row["matched"], row["reason"]


@pytest.mark.parametrize(("text", "want"), [
    (None, (False, "empty")), (" \n", (False, "empty")), ("nothing here", (False, "no_match")),
    ("news from Lake Brook County", (False, "entity_other:far")), ("news from Brook County", (True, "entity_local:county")),
    ("Brook County, Wyoming", (False, "entity_other:county")), ("horoscope of the day", (False, "hard_negative")),
    ("horoscope by Brookvale Council", (True, "strong_positive_over_negative")), ("horoscope giveaway by Brookvale Council", (False, "hard_negative")),
    ("Brookvale Council meets", (True, "strong_positive")), ("Brookvale Council of Wyoming", (False, "entity_other:county")), ("Brookvale Council and the Milford ferry", (False, "hard_negative:overseas")),
    ("at Hartley Green", (True, "town_local")), ("tonight at The Lantern", (True, "event_local_venue:the lantern")), ("The Lantern", (False, "no_match")), ("tickets", (False, "no_match")),
    ("Dunmore overseas", (False, "hard_negative:overseas")), ("Dunmore tri county overseas", (True, "ambiguous_with_context:dunmore")), ("Milford and Hartley", (True, "multi_local_places")),
    ("Milford, Hartley, Dunmore ferry", (True, "multi_local_places")), ("East Milford and Milford", (False, "ambiguous_no_context:east milford")), ("Milford and Dunmore", (False, "bare_milford")),
    ("Milford upstate", (True, "milford_with_context")), ("Milford @upstate", (False, "bare_milford")), ("read @hartley.example now", (False, "no_match")), ("upstate @hartley", (False, "no_match")), ("mail me@hartley.example", (False, "ambiguous_no_context:hartley")), ("@upstate.example Milford and Hartley", (True, "multi_local_places")), ("hartley fc", (False, "hard_negative:handle")), ("hartley", (False, "ambiguous_no_context:hartley")),
    ("farther towns, far  town", (False, "entity_other:far")),
])
def test_order_of_rules(spark, text, want):
    assert verdict(spark, text) == want


def test_language_gate(spark):
    assert verdict(spark, "milford", langs=["fr_CA"]) == (False, "lang_non_local:fr")
    assert verdict(spark, "milford", langs=["fr", "en"]) == (False, "bare_milford")
    assert verdict(spark, "milford upstate", langs=["fr"]) == (True, "milford_with_context")


def test_anchored_context_of_its_own(spark):
    """Conflicts are lifted by the anchored class where a pack has one, not by the context of ambiguous places."""
    from dataclasses import replace

    pack = replace(PACK, classes=PACK.classes | {"anchored_context": ("brook state",)})
    df = spark.createDataFrame([(1, "hartley fc upstate"), (2, "hartley fc in brook state"), (3, "hartley fc")], "i int, text string")
    got = {r["i"]: r["reason"] for r in cascade.decide(df, pack, LEXICON).collect()}
    assert got == {1: "hard_negative:handle", 2: "ambiguous_no_context:hartley", 3: "hard_negative:handle"}


def test_several_places_without_the_excluded_meet_a_set(spark):
    from dataclasses import replace

    pack = replace(PACK, multi_conflicts=(SetConflict("overseas", ("milford",)),), only_conflicts=(), term_conflicts=())
    df = spark.createDataFrame([(1, "Milford, Hartley, Dunmore ferry"), (2, "East Milford, Hartley ferry to Milford")], "i int, text string")
    assert {r["i"]: r["reason"] for r in cascade.decide(df, pack, LEXICON).collect()} == {1: "hard_negative:overseas", 2: "multi_local_places"}


def test_prior_handle_alt_text(spark):
    assert verdict(spark, "milford", soft_prior=True) == (True, "soft_prior_ambiguous:milford")
    assert verdict(spark, "hartley", author_handle="x.hartleyfc.example") == (False, "hard_negative:handle")
    assert verdict(spark, "look", alt_text="Brookvale Council sign") == (True, "strong_positive")


@pytest.mark.parametrize(("text", "want"), [
    ("mill lane and orchard row", (True, "classifier:local_micro")), ("mill lane", (False, "no_match")), ("mill lane tonight", (True, "classifier:local_micro")),
    ("hartley by mill lane", (True, "classifier:ambiguous:hartley")), ("river street and mill lane in brookvale", (True, "classifier:local_micro")),
    ("river street and mill lane", (False, "no_match")), ("river street and mill lane in brookvale, savannah", (False, "no_match")),
])
def test_linear_scorer(spark, text, want):
    assert verdict(spark, text, MODEL) == want


def test_allowlists_come_first(spark):
    df = spark.createDataFrame([("", "d1", "H.One"), ("horoscope", "d2", "h.two"), ("x", "d3", "h.three")], "text string, author_did string, author_handle string")
    dids, handles = spark.createDataFrame([("d1",), ("d1",)], "did string"), spark.createDataFrame([("h.two",)], "handle string")
    got = {r["author_did"]: r["reason"] for r in cascade.decide(df, PACK, LEXICON, allow_dids=dids, allow_handles=handles).collect()}
    assert got == {"d1": "allowlist_did", "d2": "allowlist_handle", "d3": "no_match"}


def sequential(text):
    """The same rules read one after the other."""
    t = " ".join(text.split())
    has = lambda terms: any(re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t, re.I) for x in terms)
    c = PACK.classes
    if not t:
        return "empty"
    surfaces = [s for s in LEXICON.surfaces if has([s.surface])]
    if surfaces and surfaces[0].region == "other":
        return f"entity_other:{surfaces[0].entity_id}"
    if has(c["hard_negative"]):
        return "strong_positive_over_negative" if has(c["strong"]) and not has(c["blocks_strong"]) else "hard_negative"
    if surfaces:
        return f"entity_local:{surfaces[0].entity_id}"
    if has(c["strong"]):
        return "strong_positive"
    if has(c["town_local"]):
        return "town_local"
    if has(c["event_cue"]) and has(c["venue"]):
        return "event_local_venue:the lantern"
    found = list(dict.fromkeys(m.group(0).lower() for m in re.finditer(r"(?<!\w)(?:east milford|milford|hartley)(?!\w)", t, re.I)))
    several = [x for x in found if not any(x != y and x in y for y in found)]
    if len(several) >= 2:
        return "multi_local_places"
    if found:
        term = min(found)
        if has(c["context"]):
            return "milford_with_context" if term == "milford" else f"ambiguous_with_context:{term}"
        return "bare_milford" if term == "milford" else f"ambiguous_no_context:{term}"
    return "no_match"


def test_against_sequential_reading(spark):
    rng = random.Random(7)
    words = ["Milford", "east milford", "HARTLEY", "upstate", "horoscope", "Brookvale Council", "giveaway", "hartley green", "tonight", "the lantern", "brook county", "far town", "x", "and", "\n", "milfordian"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["reason"] for r in cascade.decide(df, PACK, LEXICON).collect()}
    assert {i: (texts[i], got[i]) for i in got} == {i: (t, sequential(t)) for i, t in enumerate(texts)}


def test_each_class_is_matched_once_in_the_plan(spark):
    """Words are split once, and for texts with mentions once more for places and for their context."""
    from townwire.operators import rules

    df = spark.createDataFrame([("a",)], "text string")
    plan = cascade.decide(df, PACK, LEXICON)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("horoscope") == 1 and plan.count(rules.NOT_WORD) == 3 and "Exchange" not in cascade.decide(df, PACK, LEXICON)._jdf.queryExecution().executedPlan().toString()


def test_rules_before_the_prior_are_tested_once(spark):
    """Both answers to the prior share the rules that don't read it, and agree with the cascade for either."""
    df = spark.createDataFrame([("a",)], "text string")
    plan = cascade.decide(df, PACK, LEXICON, MODEL, both_priors=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lang_non_local:fr") == 1
    rng = random.Random(3)
    terms = ["Milford", "Hartley", "Dunmore", "ferry", "tonight", "The Lantern", "mill lane", "upstate", "horoscope", "Brookvale Council", "Brook County", "Wyoming", "@hartley.x", "and", "hartleys", "MILF"]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(terms, k=rng.randint(0, 5)))) for i in range(400)], "i int, text string")
    both = {r["i"]: (r["reason"], r["reason_with_prior"]) for r in cascade.decide(texts, PACK, LEXICON, MODEL, both_priors=True).collect()}
    alone = [{r["i"]: r["reason"] for r in cascade.decide(texts.withColumn("soft_prior", F.lit(p)), PACK, LEXICON, MODEL).collect()} for p in (False, True)]
    assert both == {i: (alone[0][i], alone[1][i]) for i in both} and any(a != b for a, b in both.values())


def test_words_need_no_regular_expression(spark):
    """Single words have none; there is one for each surface of several words."""
    from townwire.plans import registry

    df = spark.createDataFrame([("a",)], "text string")
    plan = registry.decided(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2


def windows_by_force(text, triggers, cues, window):
    low = " ".join(text.split()).lower()
    found = lambda terms: [(m.start(1), m.end(1)) for t in terms for m in re.finditer(rf"(?=(?<!\w)({re.escape(t)})(?!\w))", low)]
    apart = lambda x, y: 0 <= y[0] - x[1] <= window
    return any(apart(x, y) or apart(y, x) for x in found(triggers) for y in found(cues))


@pytest.mark.parametrize(("triggers", "cues", "window"), [
    (("aa", "b"), ("c", "é"), 5), (("aa", "b"), ("c", "b"), 2), (("a b", "b"), ("b c", "é"), 4), (("aa",), ("aa",), 3), (("c.", "b"), ("é b", "aa"), 6), (("b",), ("c",), 0), (("b",), ("c",), 1),
])
def test_windows_against_force(spark, triggers, cues, window):
    from townwire.operators import rules

    rng = random.Random(str(triggers))
    words = ["aa", "b", "c", "é", "É", "aab", "c.", "xxxx", "b,c", "yyyyyyy", rules.MARK]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)] + ["aa 123 c", "c b", "aa 12345 c", "b" * 3 + " " + "b " * 400 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = Conflict("x", triggers, cues=cues, window=window)
    d, read = reading(df, F.col("t"))
    d, cut = rules.with_pieces(d, read, [c, Conflict("y", ("xxxx",), cues=("yyyyyyy",))])
    flags = {r["i"]: (r["alone"], r["shared"]) for r in d.select("i", c.condition(read, F.lit(None), F.lit(False)).alias("alone"), c.condition(cut, F.lit(None), F.lit(False)).alias("shared")).collect()}
    want = {i: windows_by_force(t, triggers, cues, window) for i, t in enumerate(texts)}
    keep = {i for i, t in enumerate(texts) if rules.MARK not in t}
    assert {i: (texts[i], *flags[i]) for i in keep} == {i: (texts[i], want[i], want[i]) for i in keep}
    # the naive reader finds 9 texts for a term near itself, and none where no words can touch
    assert sum(want.values()) < 304 and (sum(want.values()) > 5 or window == 0)


def test_windows_take_no_regular_expression_test(spark):
    from townwire.plans import rule_queries

    df = spark.createDataFrame([("a", "h")], "text string, author_handle string")
    plan = cascade.decide(df, rule_queries.pack(), rule_queries.lexicon(), rule_queries.model())._jdf.queryExecution().optimizedPlan().toString()
    assert "{0," not in plan and plan.count("\ue000$1") == 1


def narrow_hits(df, lex):
    d, read = reading(df, F.col("t"))
    return {r["k"]: (r["h"]["entity_id"], r["h"]["surface"]) for r in d.select("k", lex.hit(read).alias("h")).collect() if r["h"]}


def test_lexicon(spark):
    with pytest.raises(ValueError, match="region"):
        Lexicon.of([{"id": "x", "region": "moon", "surfaces": ["y"]}])
    lex = Lexicon.of([{"id": "a", "region": "local", "surfaces": ["one two", "three"]}, {"id": "b", "region": "other", "surfaces": ["two three four", "three"]}])
    rows = [(1, "one two three four"), (2, "One Two"), (3, "three"), (4, "ones"), (5, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    want = {1: ("b", "two three four"), 2: ("a", "one two"), 3: ("a", "three")}
    narrow = narrow_hits(df, lex)
    joined = {r["k"]: (r["entity_id"], r["surface"]) for r in join_hits(df, lex.table(spark), "k", "t").collect()}
    assert narrow == joined == want


def test_lexicon_of_many_surfaces_reads_alike(spark, monkeypatch):
    from townwire.operators import lexicon

    rng = random.Random(3)
    names = ["".join(rng.choices("ab", k=rng.randint(1, 2))) for _ in range(60)]
    surfaces = list(dict.fromkeys(" ".join(rng.choices(names, k=rng.randint(1, 3))) for _ in range(40)))
    lex = Lexicon.of([{"id": str(i), "region": "local", "surfaces": [s]} for i, s in enumerate(surfaces)])
    df = spark.createDataFrame([(i, rng.choice([" ", ", ", " ("]).join(rng.choices(names, k=rng.randint(0, 6)))) for i in range(200)], "k int, t string")
    few = narrow_hits(df, lex)
    monkeypatch.setattr(lexicon, "ONE_BY_ONE", 0)
    assert few == narrow_hits(df, lex) and len(few) > 50


def test_join_hits_of_any_length(spark):
    lex = Lexicon.of([{"id": "a", "region": "local", "surfaces": ["st. mary's", "mary"]}, {"id": "b", "region": "other", "surfaces": ["one two three four five six seven", "six"]}])
    df = spark.createDataFrame([(1, "at st. mary's now"), (2, "one two three four five six seven"), (3, "mary and six"), (4, "none")], "k int, t string")
    narrow = narrow_hits(df, lex)
    joined = {r["k"]: (r["entity_id"], r["surface"]) for r in join_hits(df, lex.table(spark), "k", "t").collect()}
    assert joined == narrow == {1: ("a", "st. mary's"), 2: ("b", "one two three four five six seven"), 3: ("a", "mary")}
    assert join_hits(df, Lexicon(()).table(spark), "k", "t").count() == 0


def test_small_lexicon_is_broadcast(spark, monkeypatch):
    """Only hits are shuffled, once; larger lexicons meet all n-grams, with the same hits."""
    from townwire.operators import lexicon

    lex = Lexicon.of([{"id": "a", "region": "local", "surfaces": ["one two", "three"]}])
    df = spark.createDataFrame([(i, f"one two {i}") for i in range(20)], "k int, t string")
    small = join_hits(df, lex.table(spark), "k", "t")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(lower(t") == 1  # tokens are made once a text, not for each n-gram
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(lexicon, "SENT", 0)
    assert sorted(small.collect()) == sorted(join_hits(df, lex.table(spark), "k", "t").collect()) and small.count() == 20


def test_automaton_reads_as_the_rules_do(spark):
    """100 surfaces against the plan of regular expressions; parts of any size give the same."""
    from townwire.operators import automaton

    rng = random.Random(4)
    names = ["".join(rng.choices("abé", k=rng.randint(1, 2))) for _ in range(50)]
    surfaces = list(dict.fromkeys([" ".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(95)] + ["st. a", "a-b", "b's", "(a)", "é, b"]))
    lex = Lexicon.of([{"id": str(i), "region": "local", "surfaces": [s]} for i, s in enumerate(surfaces)] + [{"id": "again", "region": "other", "surfaces": surfaces[:3]}])
    texts = [rng.choice([" ", ", ", "-", " (", ". ", "'"]).join(rng.choices([*names, "St", "s", "A"], k=rng.randint(0, 7))) for _ in range(300)] + ["st.  a", "st.\ta", "É, B", "a -b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t"))
    narrow = narrow_hits(df, lex)
    for part in (automaton.PART_TOKENS, 40):
        got = {r["k"]: (r["entity_id"], r["surface"]) for r in automaton.longest_hits(df, lex.table(spark), "k", "t", part).collect()}
        assert {k: (texts[k], got.get(k), narrow.get(k)) for k in {*got, *narrow} if got.get(k) != narrow.get(k)} == {}
    assert len(narrow) > 50
    assert automaton.longest_hits(df, Lexicon(()).table(spark), "k", "t").count() == 0
    plan = automaton.longest_hits(df, lex.table(spark), "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_large_lexicon_stays_off_the_driver(spark, monkeypatch):
    """A lexicon of many parts is compiled by tasks; each text is sent in stretches that are no more for more parts."""
    from townwire.operators import automaton

    rng = random.Random(6)
    names = ["".join(rng.choices("abé", k=rng.randint(1, 3))) for _ in range(60)]
    surfaces = list(dict.fromkeys(" ".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(400)))
    lex = Lexicon.of([{"id": str(i), "region": "local", "surfaces": [s]} for i, s in enumerate(surfaces)]).table(spark)
    texts = [rng.choice([" ", ", ", " ("]).join(rng.choices(names, k=rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = {tuple(r) for r in automaton.longest_hits(df, lex, "k", "t").collect()}
    monkeypatch.setattr(automaton, "Automaton", None)  # no part may be compiled here
    assert {tuple(r) for r in automaton.longest_hits(df, lex, "k", "t", 30).collect()} == want and len(want) > 100
    text = " ".join(rng.choices(names, k=500))
    for parts in (10, 1_000):
        assert sum(len(s) for own in automaton.stretches(text, parts, 2, 3).values() for s in own) <= 3 * len(text)


def test_backfill_reads_its_payloads_once(spark, monkeypatch):
    """Gated posts are stored before they are split; no plan behind them reads the payloads, and none joins them with themselves."""
    from townwire.plans import rule_queries

    read = []
    whole = rule_queries.live.backfill
    monkeypatch.setattr(rule_queries.live, "backfill", lambda posts, *a, **k: read.append(posts) or whole(posts, *a, **k))
    for part in rule_queries._backfill(spark, "/root/testdata/sf0.001"):
        assert not any("documents" in f for f in part.inputFiles())
    assert "Join" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
