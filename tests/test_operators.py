"""History, index, ranking, gates, audit, evaluation, curation and screening on literal rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from townwire.operators import audit, curate, evaluate, gates, index, priors, ranking, screening

T0 = datetime(2024, 1, 1)


def at(**k):
    return T0 + timedelta(**k)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sequential_priors(posts, least, days):
    state, out = {}, {}
    for key, author, ts, strong in sorted(posts, key=lambda p: (p[2], p[0])):
        n, last = state.get(author, (0, None))
        out[key] = bool(author) and n >= least and last is not None and ts - last <= timedelta(days=days)
        if strong and author:
            state[author] = (n + 1 if last is not None and ts - last <= timedelta(days=days) else 1, ts)
    return out, state


def test_priors_against_a_sequential_run(spark):
    rng = random.Random(3)
    posts = [(i, rng.choice(["a", "b", "c", "", None]), at(hours=rng.randrange(0, 2400)), rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(posts, "k int, author string, ts timestamp, strong boolean")
    got = {r["k"]: r["soft_prior"] for r in priors.with_prior(df, "author", "ts", "k", "strong", 3, 2).collect()}
    want, state = sequential_priors(posts, 3, 2)
    assert got == want and sum(want.values()) > 20
    stats = {r["author"]: (r["strong_match_count"], r["last_strong_at"]) for r in priors.author_stats(df.filter("author <> ''"), "author", "ts", "k", "strong", 2).collect()}
    assert stats == {a: s for a, s in state.items() if a}


@pytest.mark.parametrize("slot", ["minute", "hour", "day", "year"])
def test_priors_do_not_depend_on_slots(spark, slot):
    rng = random.Random(slot)
    posts = [(i, rng.choice(["a", "a", "b"]), at(minutes=rng.randrange(0, 20_000)), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(posts, "k int, author string, ts timestamp, strong boolean")
    want, state = sequential_priors(posts, 3, 0.2)
    assert {r["k"]: r["soft_prior"] for r in priors.with_prior(df, "author", "ts", "k", "strong", 3, 0.2, slot).collect()} == want and sum(want.values()) > 10
    stats = {r["author"]: (r["strong_match_count"], r["last_strong_at"]) for r in priors.author_stats(df, "author", "ts", "k", "strong", 0.2, slot).collect()}
    assert stats == state


def test_a_hot_author_is_spread_over_slots(spark):
    """One author has a third of all rows: no window takes them together, and the rows are shuffled once."""
    posts = [(i, "hot" if i % 3 == 0 else f"a{i % 50}", at(minutes=7 * i), i % 2 == 0) for i in range(3_000)]
    df = spark.createDataFrame(posts, "k int, author string, ts timestamp, strong boolean")
    out = priors.with_prior(df, "author", "ts", "k", "strong", 3, 2)
    assert {r["k"]: r["soft_prior"] for r in out.collect()} == sequential_priors(posts, 3, 2)[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "k#" in line]
    assert windows and all("[author#" in line and "_townwire_slot#" in line.split("], [")[-2] for line in windows), windows
    within = priors._within_slots(df, "author", "ts", "k", "strong", 2, priors.SLOT)
    assert within.groupBy("author", "_townwire_slot").count().agg(F.max("count")).first()[0] <= 9


def test_prior_bounds(spark):
    stats = spark.createDataFrame([("a", 3, at(days=0)), ("b", 2, at(days=0)), ("c", 9, at(seconds=-1))], "author string, strong_match_count int, last_strong_at timestamp")
    assert rows(priors.eligible(stats, F.lit(at(days=30))), "author") == [("a",)]


def test_fold_and_inserts(spark):
    c = [("u1", "create", 1, "a"), ("u1", "create", 2, "b"), ("u2", "create", 1, "c"), ("u2", "delete", 2, None), ("u3", "create", 1, "d"), ("u3", "delete", 2, None), ("u3", "create", 3, "e"), ("", "create", 1, "f"), ("u4", "update", 1, "g"), ("u5", "create", 2, "h"), ("u5", "delete", 2, None)]
    df = spark.createDataFrame([(u, o, at(hours=h), x) for u, o, h, x in c], "uri string, operation string, ts timestamp, cid string")
    assert rows(index.fold(df), "uri", "cid") == [("u1", "a"), ("u3", "e")]
    assert rows(index.new_rows(df.filter("operation = 'create' and uri <> ''"), spark.createDataFrame([("u1",)], "uri string"), "uri", "ts"), "uri", "cid") == [("u2", "c"), ("u3", "d"), ("u5", "h")]


def test_engagement_retention_schema(spark):
    idx = spark.createDataFrame([("u1", at(hours=5), 1), ("u2", at(hours=5), None)], "uri string, indexed_at timestamp, like_count long")
    e = spark.createDataFrame([("like", "u1", at(hours=4)), ("like", "u1", at(hours=5)), ("repost", "u1", at(hours=6)), ("like", "zz", at(hours=9))], "kind string, subject_uri string, ts timestamp")
    assert rows(index.engagement_counts(idx, e), "uri", "like_count", "repost_count") == [("u1", 2, 1), ("u2", 0, 0)]
    assert rows(index.engagement_counts(idx, e, as_of=False), "uri", "like_count") == [("u1", 3), ("u2", 0)]
    assert rows(index.retained(idx, F.lit(at(days=7, hours=5))), "uri") == [("u1",), ("u2",)] and index.retained(idx, F.lit(at(days=7, hours=6))).count() == 0
    grown = index.with_columns_of(idx, {"like_count": F.lit(0), "repost_count": F.lit(0)})
    assert rows(grown, "uri", "like_count", "repost_count") == [("u1", 1, 0), ("u2", 0, 0)]


def posts_index(spark):
    rng = random.Random(1)
    data = [(f"u{i:02}", f"c{rng.randrange(4)}", None if i % 5 == 0 else at(hours=rng.randrange(5)), at(hours=rng.randrange(5), microseconds=rng.randrange(3)), rng.randrange(3), rng.randrange(3)) for i in range(45)]
    return data, spark.createDataFrame(data, "uri string, cid string, created_at timestamp, indexed_at timestamp, like_count long, repost_count long")


@pytest.mark.parametrize("mode", ["indexed", "created", "engagement"])
def test_pages_have_no_gaps(spark, mode):
    data, df = posts_index(spark)
    low = datetime(1, 1, 1)
    keys = {"indexed": lambda r: (r[3], r[1], r[0]), "created": lambda r: (r[2] or low, r[3], r[1], r[0]), "engagement": lambda r: (r[4] + 2 * r[5], r[3], r[1], r[0])}
    want = [r[0] for r in sorted(data, key=keys[mode], reverse=True)]
    own, seen, cursor = ranking.rankings()[mode], [], None
    while page := own.page(df, cursor, 16).collect():
        seen += [r["uri"] for r in page]
        cursor = page[-1]["next_cursor"]
    assert seen == want
    numbers = {r["uri"]: (r["position"], r["page"]) for r in ranking.page_numbers(df, own, 16).collect()}
    assert numbers == {u: (i, i // 16) for i, u in enumerate(want)}


def test_page_arguments(spark):
    _, df = posts_index(spark)
    own = ranking.rankings()["created"]
    assert own.page(df, ranking.END).count() == 0
    for bad in ("", "1::2", "x::1::00::00", "1::2::zz::00"):
        with pytest.raises(ValueError, match="malformed"):
            own.page(df, bad)
    assert [ranking.clamp(n) for n in (None, 0, 5, 1000)] == [20, 1, 5, 100]


def test_gates(spark):
    df = spark.createDataFrame([("r", True, at(days=5), "x"), ("old", False, at(days=3), "x"), ("new", False, at(days=4), "x"), ("m", False, None, "A SpOiler here"), ("ok", False, None, None)], "k string, reply boolean, created timestamp, text string")
    gate = lambda c, **k: {r["k"]: r["g"] for r in df.select("k", gates.gate_reason(c, is_reply=F.col("reply"), created=F.col("created"), reference=F.lit(at(days=5)), text=F.col("text"), alt=F.lit(None), **k).alias("g")).collect()}
    config = gates.FeedConfig(muted=("spoiler",))
    assert gate(config) == {"r": "reply_ignored", "old": "archived", "new": None, "m": "muted", "ok": None}
    assert gate(config, archive=False)["old"] is None
    assert set(gate(gates.FeedConfig(ignore_replies=False, ignore_archived=False)).values()) == {None}


def test_audit_and_purge(spark):
    idx = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "uri string, match_reason string")
    hydrated = spark.createDataFrame([("a", "one\ntwo"), ("b", None)], "uri string, text string")
    decided = spark.createDataFrame([("a", True, "strong_positive"), ("b", False, "no_match")], "uri string, matched boolean, reason string")
    got = audit.audit(idx, hydrated, decided)
    assert rows(got, "uri", "status", "reason", "text_preview") == [("a", "kept", "strong_positive", "one two"), ("b", "dropped", "no_match", ""), ("c", "not_found", "not_found", "")]
    assert rows(audit.purge(idx, got), "uri") == [("a",), ("c",)] and rows(audit.outcome_counts(got), "status", "n") == [("dropped", 1), ("kept", 1), ("not_found", 1)]


def test_evaluation(spark):
    data = [(1, True, True, "dev", "text", "x", True), (2, False, True, "dev", "text", "y", True), (3, True, False, "holdout", "event", "x", False), (4, False, False, "holdout", "event", "x", None)]
    df = spark.createDataFrame(data, "id int, expected boolean, matched boolean, split string, signal string, bucket string, regression boolean")
    got = {(r["stratum"], r["value"]): (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"], r["precision_defined"]) for r in evaluate.confusion(df).collect()}
    assert got["overall", ""] == (1, 1, 1, 1, 0.5, 0.5, True) and got["split", "holdout"] == (0, 0, 1, 1, 0.0, 0.0, False) and got["bucket", "x"] == (1, 0, 1, 1, 1.0, 0.5, True) and len(got) == 7
    assert rows(evaluate.failures(df), "id", "kind") == [(2, "FP"), (3, "FN")]
    assert tuple(evaluate.gate(df).first()) == (2, 1, False)
    assert rows(evaluate.coverage(df, {"split": ["dev", "none"]}), "stratum", "value", "n") == [("split", "dev", 2), ("split", "none", 0)]


def test_curation(spark):
    raw = spark.createDataFrame([("1", "a", True, None, "low note"), ("2", " ", False, "dev", None), ("3", "c", None, "odd", None)], "id string, text string, expected boolean, split string, note string")
    got = curate.normalize_cases(raw)
    assert [(r["id"], r["split"], r["bucket"], r["regression"], r["error"]) for r in got.orderBy("id").collect()] == [("1", "dev", "uncategorized", True, None), ("2", "dev", "uncategorized", True, None), ("3", "odd", "uncategorized", True, None)]
    odd = raw.withColumn("expected", F.lit(True))
    assert [r["error"] for r in curate.normalize_cases(odd).orderBy("id").collect()] == [None, None, "unknown split odd"]
    with pytest.raises(Exception, match="unknown split odd"):
        curate.normalize_cases(odd, strict=True).collect()
    tagged = spark.createDataFrame([("1", "", True, ["en", "", None]), ("2", "", True, []), ("3", "", True, None)], "id string, text string, expected boolean, langs array<string>")
    assert [r["langs"] for r in curate.normalize_cases(tagged).orderBy("id").collect()] == [["en"], None, None]
    existing = spark.createDataFrame([("1", "old", False)], "id string, text string, expected boolean")
    incoming = spark.createDataFrame([("1", "new", True), ("2", "x", True), ("2", "y", True), ("3", "z", None)], "id string, text string, expected boolean")
    merged, counters = curate.merge_cases(existing, incoming)
    assert rows(merged, "id", "text") == [("1", "old"), ("2", "x")] and counters.first().asDict() == {"added": 1, "skipped_unlabeled": 1, "skipped_existing": 2, "rejected": 0}
    answers = spark.createDataFrame([("1", '```json\n{"expected": true, "rationale": " r ", "confidence": "High"}\n```'), ("2", "no"), ("3", 'x {"expected": "maybe"} y')], "id string, response string")
    p = curate.parse_proposals(answers)
    assert rows(p, "id", "proposed_confidence", "error") == [("1", "high", None), ("2", "medium", "no object"), ("3", "medium", "expected is not a boolean")]
    attached = curate.attach_proposals(raw.select("id", "note"), p)
    assert [(r["id"], r["note"], r["needs_human_confirm"]) for r in attached.orderBy("id").collect()] == [("1", "low note | llm propose expected=True (high): r", True), ("2", "llm error: no object", True), ("3", "llm error: expected is not a boolean", True)]


def test_sets_of_keys(spark):
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    two = spark.createDataFrame([("b", 2), ("c", 3), ("c", 2)], "k string, v int")
    assert rows(curate.union_by_priority([one, two], "k", "v"), "k", "v") == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(curate.key_diff(one, two, "k"), "k", "side", "n") == [("a", "missing", 1), ("c", "extra", 2)]
    listed = spark.createDataFrame([("B", 2), ("b", 1), ("a", 3)], "k string, p int")
    assert rows(curate.ordered_distinct(listed, "k", "p", ignore_case=True), "k", "p") == [("a", 3), ("b", 1)]
    assert rows(curate.newest_per(two, "k", 1, F.desc("v")), "k", "v") == [("b", 2), ("c", 3)]
    assert rows(curate.resolve_handles(spark.createDataFrame([("X",), ("y",), ("z",)], "handle string"), spark.createDataFrame([("x", "d1"), ("z", "d2"), ("Z", "d3")], "handle string, did string")), "handle", "status") == [("x", "ok"), ("y", "unresolved"), ("z", "ambiguous")]


def test_screening(spark):
    posts = [("busy", at(hours=i % 100), f"text {i}") for i in range(150)] + [("same", at(hours=1), "the same words") for _ in range(9)] + [("fine", at(hours=1), "hello")] + [("promo", at(hours=2), "Buy now")]
    df = spark.createDataFrame(posts, "author string, ts timestamp, text string")
    act = screening.activity(df, "author", "ts", "text", F.lit(at(days=5)))
    got = screening.with_recommendation(screening.with_flags(screening.pattern_hits(act, {"promo": ("buy now",)})))
    assert {r["author"]: (r["flags"], r["recommendation"]) for r in got.collect()} == {"busy": (["high_volume"], "reject"), "same": (["low_diversity"], "review"), "fine": ([], "likely_ok"), "promo": (["slop:promo"], "review")}


def test_cases_need_booleans(spark):
    raw = spark.createDataFrame([("a", "t", "yes", None), ("\t ", "t", "true", None), ("b", "t", None, "no")], "id string, text string, expected string, regression string")
    got = {r["id"]: (r["expected"], r["error"]) for r in curate.normalize_cases(raw).collect()}
    assert got == {"a": (None, "expected must be a boolean"), "": (None, "expected must be a boolean"), "b": (None, None)}
    odd = spark.createDataFrame([("a", "t", True, "no")], "id string, text string, expected boolean, regression string")
    assert curate.normalize_cases(odd).first()["error"] == "regression must be a boolean"
    assert tuple(curate.merge_cases(raw.limit(0).withColumn("expected", F.lit(True)), raw)[1].first()) == (0, 1, 0, 2)


def test_proposals_wait_for_a_person(spark):
    rows = spark.createDataFrame([(1, " n "), (2, None), (3, "n"), (4, "n")], "id int, note string")
    answers = spark.createDataFrame([(1, '{"expected": true, "confidence": "high", "rationale": " r "}'), (2, '{"expected": false}'), (3, "none")], "id int, response string")
    got = {r["id"]: (r["expected"], r["proposed_by"], r["note"], r["needs_human_confirm"]) for r in curate.attach_proposals(rows, curate.parse_proposals(answers)).collect()}
    assert got == {
        1: (True, "llm", "n | llm propose expected=True (high): r", True), 2: (False, "llm", "llm propose expected=False (medium): ", True),
        3: (None, "llm", "n | llm error: no object", True), 4: (None, None, "n", False),
    }


def test_screening_strips_texts_and_rejects_failed_fetches(spark):
    rows = [(1, "hello", 1), (1, "hello ", 2), (1, "\thello\n", 3), (1, "\n", 4), (2, "x", 1)]
    posts = spark.createDataFrame(rows, "a int, t string, s int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    out = screening.activity(posts, "a", "ts", "t", F.lit("2024-01-02").cast("timestamp"), key="s")
    one = {r["a"]: r for r in out.collect()}
    assert one[1]["unique_prefix_ratio"] == 0.33 and one[1]["sample_texts"] == ["\thello\n", "hello ", "hello"]
    flagged = screening.with_recommendation(screening.with_flags(out, failed=F.col("a") == 2))
    assert {r["a"]: (r["flags"], r["recommendation"]) for r in flagged.collect()} == {1: ([], "likely_ok"), 2: (["fetch_error"], "reject")}


def test_sliding_activity_is_near_the_exact_one(spark):
    """Sketches of a day merge into windows: within 2 % for many prefixes, exact for few."""
    df = spark.range(60_000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id") % 40_000)).otherwise(F.concat(F.lit(" p"), F.col("id") % 9)).alias("t"), (F.lit(T0) + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("s"))
    got = {(r["a"], (r["day"] - T0.date()).days): r for r in screening.sliding(df, "a", "s", "t").collect()}
    for d in (0, 6, 20, 39):
        for a in (0, 1):
            r = got.get((a, d))
            if r is None:
                continue
            for span in (7, 30):
                own = [i for i in range(a, 60_000, 2) if d - span < i % 40 <= d]
                exact = len({i % 40_000 if a == 0 else i % 9 for i in own})
                assert r[f"posts_{span}d"] == len(own) and abs(r[f"prefixes_{span}d"] - exact) <= (0.02 * exact if a == 0 else 0)
