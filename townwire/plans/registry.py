"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townwire.functions import text as tx
from townwire.functions.times import is_archived, lag_seconds
from townwire.operators import audit as au
from townwire.operators import cascade, curate, evaluate, gates, lexicon, priors, ranking, rules, screening
from townwire.operators import index as ix
from townwire.operators.linear import LinearModel, score_rows
from townwire.packs import HERE
from townwire.plans.rule_sql import WHITE_SQL
from townwire.plans.tables import cases, commits, dealt, documents, events, index, posts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_reason_histogram"](spark, sf_dir)


def pack() -> rules.RulePack:
    return rules.load_pack(HERE / "prose.json")


def prose_lexicon() -> lexicon.Lexicon:
    return lexicon.Lexicon.load(HERE / "prose_lexicon.json")


# SQL pieces: the text with one space for each run of white space, padded so that RE2, which
# has no look-around, can test for edges of words; and the decisions of the prose pack
NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
EDGE = r"[^\p{L}\p{N}_]"


def has_sql(*terms: str, of: str = "p") -> str:
    return f"regexp_matches({of}, '{EDGE}(?:{'|'.join(terms)}){EDGE}')"


DECIDED_SQL = rf"""
    norm as (select *, {NORM} as t from src),
    padded as (select *, ' ' || replace(lower(t), ' ', '  ') || ' ' as p, ' ' || lower(t) || ' ' as q from norm),
    sig as (select *, {has_sql("ntble", "esing")} as strong, {has_sql("onbleea", "inging")} as hard, {has_sql("attion", "ertion")} as context,
      {has_sql("ering")} as ev, {has_sql("thintion")} as venue,
      {has_sql("nttion")} as near1, {has_sql("ntion")} as near2, {has_sql("of ly", of="q")} as far1, {has_sql("in the of", of="q")} as far2,
      list_filter(['erble', 'thble', 'thing', 'thtion'], lambda x: regexp_matches(p, '{EDGE}' || x || '{EDGE}')) as places from padded),
    decided as (select *,
      case when t = '' then 'empty' when far2 or (far1 and not near1) then 'entity_other:far'
        when hard and strong then 'strong_positive_over_negative' when hard then 'hard_negative' when near1 or near2 then 'entity_local:near'
        when strong then 'strong_positive' when ev and venue then 'event_local_venue:thintion' when len(places) >= 2 then 'multi_local_places'
        when len(places) = 1 and context then 'ambiguous_with_context:' || places[1] when len(places) = 1 then 'ambiguous_no_context:' || places[1]
        else 'no_match' end as reason from sig),
    verdicts as (select *, regexp_matches(reason, '^(strong_positive|strong_positive_over_negative|multi_local_places|entity_local:.*|event_local_venue:.*|ambiguous_with_context:.*)$') as matched from decided)
"""
DOCS_SQL = "src as (select doc_id as uri, text, lang, source from documents)"
CASES_SQL = """src as (select d.doc_id as uri, d.text, l.quality = 1 as expected, d.source as bucket, d.lang as signal,
      case when d.doc_id % 5 = 0 then 'holdout' else 'dev' end as split, d.doc_id % 3 = 0 as regression from labels l join documents d on l.doc_id = d.doc_id)"""
EVENTS_SQL = "ev as (select *, (props->>'$.k')::bigint as k from events)"
INDEX_SQL = """ev as (select *, (props->>'$.k')::bigint as k from events),
    idx as (select event_id::varchar as uri, 'c' || (event_id % 50)::varchar as cid, user_id as author_did, event_type as match_reason,
      case when event_id % 7 <> 0 then ts - to_hours(k % 48) end as created_at, date_trunc('hour', ts) as indexed_at, k % 11 as like_count, k % 5 as repost_count from ev)"""


def decided(rows: DataFrame) -> DataFrame:
    return cascade.decide(rows, pack(), prose_lexicon())


@query(f"with {DOCS_SQL}, {DECIDED_SQL} select matched, reason, count(*) as n from verdicts group by all")
def flagship_reason_histogram(spark, sf_dir):
    return cascade.reason_histogram(decided(posts(spark, sf_dir)))


@query(f"with {DOCS_SQL}, {DECIDED_SQL} select uri, matched, reason, split_part(reason, ':', 1) as reason_class from verdicts")
def cascade_verdicts(spark, sf_dir):
    out = decided(posts(spark, sf_dir))
    return out.select("uri", "matched", "reason", cascade.reason_class(F.col("reason")).alias("reason_class"))


@query(f"with {DOCS_SQL}, {DECIDED_SQL} select uri, case when source in ('src1', 'src2') then 'allowlist_did' else reason end as reason, source in ('src1', 'src2') or matched as matched from verdicts")
def allowlisted_verdicts(spark, sf_dir):
    allowed = spark.createDataFrame([("src1",), ("src2",)], "did string")
    return cascade.decide(posts(spark, sf_dir), pack(), prose_lexicon(), allow_dids=allowed).select("uri", "reason", "matched")


@query(rf"select doc_id, length({NORM}) as n, substr(translate(coalesce(text, ''), chr(10) || chr(13), '  '), 1, 160) as preview from documents")
def text_normalize_preview(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.char_length(tx.normalize(F.col("text"))).cast("long").alias("n"), tx.preview(F.col("text")).alias("preview"))


@query(f"select page_id, rtrim(substr(trim(chr(10) || regexp_extract(html, '<title>(.*?)</title>', 1), {WHITE_SQL}), 1, 320), {WHITE_SQL}) as title, rtrim(substr(trim(chr(9) || html, {WHITE_SQL}), 1, 320), {WHITE_SQL}) as description from pages")
def embed_clip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.clip(F.concat(F.lit("\n"), F.regexp_extract("html", "<title>(.*?)</title>", 1))).alias("title"), tx.clip(F.concat(F.lit("\t"), "html")).alias("description"))


@query("select doc_id, lang = 'fr' as gated, 'x-' || lang as tag from documents")
def lang_prefix_gate(spark, sf_dir):
    tags = tx.language_tags(F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit("_XX")), F.lit("")))
    d = documents(spark, sf_dir).withColumn("tags", tags)
    return d.select("doc_id", (tx.has_language(F.col("tags"), "fr") & ~tx.has_language(F.col("tags"), "en")).alias("gated"), F.concat(F.lit("x-"), F.split(F.get("tags", F.lit(0)), "-")[0]).alias("tag"))


@query(f"""with {EVENTS_SQL} select case event_type when 'view' then 'like' when 'click' then 'repost' else 'post' end as kind,
    case event_type when 'error' then 'delete' else 'create' end as operation, 'did:' || user_id as author_did,
    case when event_type in ('view', 'click') then 'at://' || k end as subject_uri, epoch_us(ts) as time_us from ev where event_type <> 'purchase'""")
def json_commit_decode(spark, sf_dir):
    from townwire.sources import commits as cm

    e = events(spark, sf_dir)
    collection = F.when(F.col("event_type") == "view", cm.LIKE).when(F.col("event_type") == "click", cm.REPOST).when(F.col("event_type") == "purchase", "app.other").otherwise(cm.POST)
    operation = F.when(F.col("event_type") == "error", "delete").otherwise("create")
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    line = F.concat(
        F.lit('{"kind":"commit","did":"did:'), F.col("user_id").cast("string"), F.lit('","time_us":'), micros, F.lit(',"commit":{"rkey":"'), F.col("event_id").cast("string"),
        F.lit('","operation":"'), operation, F.lit('","collection":"'), collection, F.lit('","record":{"subject":{"uri":"at://'), F.col("k").cast("string"), F.lit('"}}}}'),
    )
    return cm.decode(cm.parsed(e.select(line.alias("value")))).select("kind", "operation", "author_did", "subject_uri", "time_us")


@query("""select conv_id, turn, case when turn > 0 then 'reply_ignored' when contains(lower(coalesce(text, '')), 'the') then 'muted' end as gate from conversations""")
def post_gates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("timestamp")
    gate = gates.gate_reason(gates.FeedConfig(muted=("THE",)), is_reply=F.col("turn") > 0, created=null, reference=null, text=F.col("text"), alt=F.lit(None), archive=False)
    return c.select("conv_id", "turn", gate.alias("gate"))


@query(f"""with {EVENTS_SQL} select event_id, case when event_id % 9 = 0 then false else ts - (ts - to_hours(k)) > interval 1 day end as archived,
    greatest(0.0, k * 3600.0)::double as lag_s from ev""")
def archive_gate(spark, sf_dir):
    e = events(spark, sf_dir)
    created = F.when(F.col("event_id") % 9 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), F.col("k").cast("int")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", is_archived(created, F.col("ts")).alias("archived"), lag_seconds(micros - F.col("k") * 3_600_000_000, micros).alias("lag_s"))


COMMON_LEXICON = [{"id": "a", "region": "other", "surfaces": ["the the", "of ly"]}, {"id": "b", "region": "local", "surfaces": ["nttion", "the"]}, {"id": "c", "region": "local", "surfaces": ["in of"]}]
HIT_SQL = f"""lex(surface, entity_id, region, ord) as (values ('the the', 'a', 'other', 0), ('nttion', 'b', 'local', 1), ('of ly', 'a', 'other', 2), ('in of', 'c', 'local', 3), ('the', 'b', 'local', 4)),
    ranked as (select t.*, lex.*, row_number() over (partition by key order by length(surface) desc, ord) as rn from t join lex on regexp_matches(p, '{EDGE}' || surface || '{EDGE}'))"""


@query(rf"with t as (select doc_id as key, ' ' || lower({NORM}) || ' ' as p from documents), {HIT_SQL} select key as doc_id, entity_id, region, surface from ranked where rn = 1")
def lexicon_longest_match(spark, sf_dir):
    lex = lexicon.Lexicon.of(COMMON_LEXICON)
    d, read = rules.reading(documents(spark, sf_dir), tx.normalize(F.col("text")))
    return rules.once(d.select("doc_id", lex.hit(read).alias("h")), hit=F.col("h")).filter("hit is not null").select("doc_id", "hit.*")


@query(rf"with t as (select conv_id * 1000 + turn as key, ' ' || lower({NORM}) || ' ' as p from conversations), {HIT_SQL} select key as post_id, entity_id, region, surface from ranked where rn = 1")
def lexicon_join(spark, sf_dir):
    lex = lexicon.Lexicon.of(COMMON_LEXICON)
    c = dealt(table(spark, sf_dir, "conversations"), "conv_id", "turn").select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), tx.normalize(F.col("text")).alias("t"))
    return lexicon.join_hits(c, lex.table(spark), "post_id", "t")


@query(f"with {DOCS_SQL}, {DECIDED_SQL} select uri, array_to_string(places, ',') as places, len(places)::int as n, places[1] as term from verdicts where len(places) > 0")
def ambiguous_places_set(spark, sf_dir):
    d, read = rules.reading(posts(spark, sf_dir), tx.normalize(F.col("text")))
    d = rules.once(d, found=pack().all_of("ambiguous", read)).filter(F.size("found") > 0)
    return d.select("uri", F.array_join(F.array_sort("found"), ",").alias("places"), F.size(cascade.distinct_places(F.col("found"), ())).alias("n"), cascade.chosen_term(F.col("found"), ()).alias("term"))


@query(rf"""with t as (select doc_id, ' ' || lower({NORM}) || ' ' as p from documents)
    select doc_id from t where regexp_matches(p, '{EDGE}(?:thble|thing)(?:{EDGE}|{EDGE}[\s\S]{{0,158}}{EDGE})(?:that|this){EDGE}') or regexp_matches(p, '{EDGE}(?:that|this)(?:{EDGE}|{EDGE}[\s\S]{{0,158}}{EDGE})(?:thble|thing){EDGE}')""")
def cooccurrence_conflict(spark, sf_dir):
    d, read = rules.reading(documents(spark, sf_dir), tx.normalize(F.col("text")))
    rule = pack().conflicts["far_prose"]
    return d.filter(rule.condition(read, F.lit(None).cast("string"), F.lit(False))).select("doc_id")


MODEL = LinearModel({"bias": -1.0, "micro": 0.75, "place": 0.5, "event": 1.25}, threshold=0.5)


@query(rf"""with t as (select doc_id, ' ' || replace(lower({NORM}), ' ', '  ') || ' ' as p from documents),
    f as (select doc_id, (regexp_matches(p, '{EDGE}ontion{EDGE}')::int + regexp_matches(p, '{EDGE}oning{EDGE}')::int) as micro, {has_sql("thble", "thtion", "thing", "erble")}::int as place, {has_sql("ering")}::int as event from t)
    select doc_id, (-1.0 + 0.75 * micro + 0.5 * place + 1.25 * event)::double as score, (-1.0 + 0.75 * micro + 0.5 * place + 1.25 * event) >= 0.5 as kept from f""")
def linear_score(spark, sf_dir):
    d, read = rules.reading(documents(spark, sf_dir), tx.normalize(F.col("text")))
    features = {"micro": F.size(pack().all_of("micro", read)).cast("double"), "place": pack().has("ambiguous", read).cast("double"), "event": pack().has("event_cue", read).cast("double")}
    return rules.once(d, score=MODEL.score(features)).select("doc_id", "score", (F.col("score") >= MODEL.threshold).alias("kept"))


@query(f"""with {EVENTS_SQL}, w(feature, weight) as (values ('view', 0.5), ('click', 1.0), ('purchase', 4.0))
    select user_id, -1.0 + sum(coalesce(k * weight, 0.0))::double as score from ev left join w on feature = event_type group by user_id""")
def sparse_score(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("event_type").alias("feature"), F.col("k").cast("double").alias("value"))
    weights = spark.createDataFrame([("view", 0.5), ("click", 1.0), ("purchase", 4.0)], "feature string, weight double")
    return score_rows(rows, weights, "user_id", bias=-1.0)


PRIOR_SQL = """ev as (select event_id, user_id, ts, event_type = 'purchase' as strong from events),
    a as (select *, last_value(case when strong then ts end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_strong_at from ev),
    b as (select *, sum((strong and (last_strong_at is null or ts - last_strong_at > interval 2 day))::int) over (partition by user_id order by ts, event_id) as session from a),
    c as (select *, sum(strong::int) over (partition by user_id, session order by ts, event_id) as total from b),
    prior as (select *, coalesce(lag(total) over (partition by user_id order by ts, event_id), 0)::bigint as strong_before from c)"""


@query(f"with {PRIOR_SQL} select event_id, strong_before, strong_before >= 3 and coalesce(ts - last_strong_at <= interval 2 day, false) as soft_prior from prior")
def author_prior_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("strong", F.col("event_type") == "purchase")
    return priors.with_prior(e, "user_id", "ts", "event_id", "strong", min_strong=3, days=2).select("event_id", "strong_before", "soft_prior")


STATS_SQL = f"{PRIOR_SQL}, stats as (select user_id, arg_max(total, session * 1000000 + total)::bigint as strong_match_count, max(ts) as last_strong_at from c where strong group by user_id)"


@query(f"with {STATS_SQL} select * from stats")
def author_strong_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("strong", F.col("event_type") == "purchase")
    return priors.author_stats(e, "user_id", "ts", "event_id", "strong", days=2)


@query(f"with {STATS_SQL} select user_id from stats where strong_match_count >= 3 and timestamp '2024-01-29' - last_strong_at <= interval 2 day")
def authors_with_prior(spark, sf_dir):
    return priors.eligible(author_strong_stats(spark, sf_dir), F.lit("2024-01-29").cast("timestamp_ntz"), 3, 2).select("user_id")


@query(f"""with {EVENTS_SQL}, r as (select k::varchar as uri, event_id, ts, row_number() over (partition by k order by ts) as rn from ev where event_type = 'signup') select uri, event_id, ts from r where rn = 1""")
def index_first_wins(spark, sf_dir):
    created = commits(spark, sf_dir).filter("operation = 'create'").select("uri", "event_id", "ts")
    return ix.first_wins(created, "uri", "ts")


@query(f"""with {EVENTS_SQL}, d as (select k, max(ts) as gone from ev where event_type = 'error' group by k),
    r as (select e.k::varchar as uri, event_id, ts, row_number() over (partition by e.k order by ts) as rn from ev e left join d on d.k = e.k where event_type = 'signup' and (gone is null or ts > gone))
    select uri, event_id, ts from r where rn = 1""")
def tombstone_fold(spark, sf_dir):
    return ix.fold(commits(spark, sf_dir)).select("uri", "event_id", "ts")


@query(f"""with {EVENTS_SQL}, old as (select distinct k from ev where event_id % 3 = 0 and k < 60), r as (select k, event_id, row_number() over (partition by k order by event_id) as rn from ev where k not in (select k from old))
    select k::varchar as uri, event_id from r where rn = 1""")
def insert_or_ignore(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("k").cast("string").alias("uri"), "event_id")
    return ix.new_rows(e, e.filter("event_id % 3 = 0 and cast(uri as long) < 60"), "uri", "event_id")


ENGAGED_SQL = f"""{EVENTS_SQL}, p as (select k, min(ts) as indexed_at from ev where event_type = 'signup' group by k),
    g as (select p.k, count(*) filter (where event_type = 'view') as l, count(*) filter (where event_type = 'click') as r from p join ev e on e.k = p.k and e.ts >= p.indexed_at group by p.k)"""


@query(f"with {ENGAGED_SQL} select p.k::varchar as uri, indexed_at, coalesce(l, 0)::bigint as like_count, coalesce(r, 0)::bigint as repost_count from p left join g on g.k = p.k")
def engagement_counts_asof(spark, sf_dir):
    idx = index_first_wins(spark, sf_dir).select("uri", F.col("ts").alias("indexed_at"))
    kind = F.when(F.col("event_type") == "view", "like").when(F.col("event_type") == "click", "repost")
    engagement = events(spark, sf_dir).filter(kind.isNotNull()).select(kind.alias("kind"), F.col("k").cast("string").alias("subject_uri"), "ts")
    return ix.engagement_counts(idx, engagement)


@query("select event_id, ts from events where ts >= (select max(ts) from events) - interval 7 day")
def retention_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("indexed_at"))
    now = e.agg(F.max("indexed_at").alias("now"))
    return ix.retained(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id", F.col("indexed_at").alias("ts"))  # one row


def _rank_sql(order: str, where: str = "true", limit: int = 100) -> str:
    return f"with {INDEX_SQL} select uri, cid, indexed_at, created_at, like_count, repost_count from idx where {where} order by {order}, cid desc, uri desc limit {limit}"


BY_SCORE = "like_count + 2 * repost_count desc, indexed_at desc"


def _page(df: DataFrame) -> DataFrame:
    return df.select("uri", "cid", "indexed_at", "created_at", "like_count", "repost_count")


@query(_rank_sql("indexed_at desc"))
def rank_indexed(spark, sf_dir):
    return _page(ranking.page_of(index(spark, sf_dir), gates.FeedConfig(), limit=100))


@query(_rank_sql("created_at desc nulls last, indexed_at desc"))
def rank_created(spark, sf_dir):
    return _page(ranking.page_of(index(spark, sf_dir), gates.FeedConfig(ranking="created"), limit=100))


@query(_rank_sql(BY_SCORE))
def rank_engagement(spark, sf_dir):
    return _page(ranking.page_of(index(spark, sf_dir), gates.FeedConfig(ranking="engagement"), limit=100))


@query(f"with {INDEX_SQL}, r as (select *, row_number() over (order by {BY_SCORE}, cid desc, uri desc) as rn from idx) select uri, cid, indexed_at, created_at, like_count, repost_count from r where rn between 41 and 60")
def page_keyset(spark, sf_dir):
    mode, rows = ranking.rankings()["engagement"], index(spark, sf_dir)
    cursor = mode.page(rows, limit=40).select("next_cursor").collect()[-1][0]  # one page
    return _page(mode.page(rows, cursor, 20))


@query(f"with {INDEX_SQL}, r as (select uri, row_number() over (order by {BY_SCORE}, cid desc, uri desc) - 1 as position from idx) select uri, position, position // 20 as page from r")
def page_numbers(spark, sf_dir):
    return ranking.page_numbers(index(spark, sf_dir), ranking.rankings()["engagement"], 20).select("uri", "position", "page")


RATES_SQL = """round(coalesce(tp / nullif(tp + fp, 0), 0.0)::double, 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0)::double, 9) as recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::double, 9) as f1, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0)::double, 9) as accuracy, tp + fp > 0 as precision_defined, tp + fn > 0 as recall_defined"""


@query(f"""with {CASES_SQL}, {DECIDED_SQL}, g as (
      select case when grouping(split) = 0 then 'split' when grouping(signal) = 0 then 'signal' when grouping(bucket) = 0 then 'bucket' else 'overall' end as stratum, coalesce(split, signal, bucket, '') as value,
      count(*) filter (where expected and matched) as tp, count(*) filter (where not expected and matched) as fp, count(*) filter (where not expected and not matched) as tn, count(*) filter (where expected and not matched) as fn
      from verdicts group by grouping sets ((), (split), (signal), (bucket))) select stratum, value, tp, fp, tn, fn, {RATES_SQL} from g""")
def eval_grouping_sets(spark, sf_dir):
    out = evaluate.confusion(decided(cases(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "accuracy")})


@query(f"with {CASES_SQL}, {DECIDED_SQL} select uri, case when matched then 'FP' else 'FN' end as kind, reason from verdicts where expected <> matched")
def eval_failures(spark, sf_dir):
    return evaluate.failures(decided(cases(spark, sf_dir))).select("uri", "kind", "reason")


@query(f"with {CASES_SQL}, {DECIDED_SQL} select count(*) filter (where regression) as regressions, count(*) filter (where regression and expected <> matched) as failed, count(*) filter (where regression and expected <> matched) = 0 as passes from verdicts")
def eval_gate(spark, sf_dir):
    return evaluate.gate(decided(cases(spark, sf_dir)))


@query(f"""with {CASES_SQL}, need(stratum, value) as (values ('split', 'dev'), ('split', 'holdout'), ('signal', 'en'), ('signal', 'xx')),
    have as (select 'split' as stratum, split as value from src union all select 'signal', signal from src) select n.stratum, n.value, count(h.value) as n from need n left join have h on h.stratum = n.stratum and h.value = n.value group by all""")
def eval_coverage(spark, sf_dir):
    return evaluate.coverage(cases(spark, sf_dir), {"split": ["dev", "holdout"], "signal": ["en", "xx"]})


AUDIT_SQL = f"""{DOCS_SQL}, {DECIDED_SQL}, audited as (select i.uri, 'old' as indexed_reason, substr(translate(coalesce(v.text, ''), chr(10) || chr(13), '  '), 1, 160) as text_preview, coalesce(v.matched, false) as matched,
    coalesce(v.reason, 'not_found') as reason, case when v.uri is null then 'not_found' when v.matched then 'kept' else 'dropped' end as status
    from (select doc_id as uri from documents) i left join (select * from verdicts where uri % 10 <> 0) v on v.uri = i.uri)"""


def _audited(spark, sf_dir):
    p = posts(spark, sf_dir)
    old = p.select("uri", F.lit("old").alias("match_reason"))
    live = p.filter("uri % 10 <> 0")
    return old, au.audit(old, live, decided(live))


@query(f"with {AUDIT_SQL} select * from audited")
def audit_rematch(spark, sf_dir):
    return _audited(spark, sf_dir)[1]


@query(f"with {AUDIT_SQL} select uri from audited where status <> 'dropped'")
def purge_anti(spark, sf_dir):
    return au.purge(*_audited(spark, sf_dir)).select("uri")


@query(f"with {AUDIT_SQL} select status, count(*) as n from audited group by all")
def audit_outcomes(spark, sf_dir):
    return au.outcome_counts(_audited(spark, sf_dir)[1])


ACTIVITY_SQL = f"""sample as (select *, k % 5 = 0 as reply, case when event_id % 11 = 0 then chr(10) else case when event_id % 2 = 0 then chr(9) else '  ' end || event_type || ' ' || (k % 7)::varchar || case when event_id % 3 = 0 then chr(160) else '' end end as body from (select *, (props->>'$.k')::bigint as k from events)),
    act as (select user_id, count(*) as sample_n, count(*) filter (where timestamp '2024-01-30' - ts <= interval 7 day) as recent_7d, count(*) filter (where timestamp '2024-01-30' - ts <= interval 30 day) as recent_30d,
      count(*) filter (where not reply and trim(body, {WHITE_SQL}) <> '') as originals, count(distinct case when not reply and trim(body, {WHITE_SQL}) <> '' then lower(substr(trim(body, {WHITE_SQL}), 1, 40)) end) as prefixes from sample group by user_id),
    newest as (select user_id, body, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from sample where not reply and trim(body, {WHITE_SQL}) <> ''),
    texts as (select user_id, string_agg(body, '|' order by rn) as sample_texts from newest where rn <= 5 group by user_id),
    rated as (select act.*, coalesce(sample_texts, '') as sample_texts, round(recent_7d / 7, 2)::double as ppd_7d, round(recent_30d / 30, 2)::double as ppd_30d, round(prefixes / greatest(originals, 1), 2)::double as unique_prefix_ratio from act left join texts using (user_id)),
    flagged as (select *, list_filter([case when user_id % 10 = 3 then 'bot' end, case when greatest(ppd_7d, ppd_30d) >= 20 then 'high_volume' when greatest(ppd_7d, ppd_30d) >= 8 then 'elevated_volume' end,
      case when unique_prefix_ratio < 0.45 and sample_n >= 8 then 'low_diversity' end, case when contains(sample_texts, 'error') then 'slop:fault' end, case when contains(sample_texts, 'click 3') or user_id % 8 = 1 then 'slop:promo' end], lambda x: x is not null) as flags from rated)"""


def _body():
    i = F.col("event_id")
    body = F.concat(F.when(i % 2 == 0, "\t").otherwise("  "), "event_type", F.lit(" "), (F.col("k") % 7).cast("string"), F.when(i % 3 == 0, "\u00a0").otherwise(""))
    return F.when(i % 11 == 0, "\n").otherwise(body)


def _screened(spark, sf_dir):
    e = events(spark, sf_dir)
    a = screening.activity(e.withColumn("body", _body()), "user_id", "ts", "body", F.lit("2024-01-30").cast("timestamp_ntz"), F.col("k") % 5 == 0, "event_id")
    profile = {"handle": F.when(F.col("user_id") % 10 == 3, "news.bot.example").otherwise("robot.example"), "description": F.when(F.col("user_id") % 8 == 1, "Link in bio, Shop now!").otherwise("")}
    return screening.pattern_hits(a.withColumns(profile), {"fault": ("error",), "promo": ("click 3", "shop now")}, "description")


@query(f"with {ACTIVITY_SQL} select user_id, sample_n, recent_7d, recent_30d, ppd_7d, ppd_30d, unique_prefix_ratio from rated")
def author_activity(spark, sf_dir):
    return _screened(spark, sf_dir).select("user_id", "sample_n", "recent_7d", "recent_30d", "ppd_7d", "ppd_30d", "unique_prefix_ratio")


@query(f"""with {ACTIVITY_SQL}, own as (select user_id, ts::date as day, case when not reply and trim(body, {WHITE_SQL}) <> '' then lower(substr(trim(body, {WHITE_SQL}), 1, 40)) end as prefix from sample),
    days as (select distinct user_id, day from own),
    spans as (select d.user_id, d.day, o.day > d.day - 7 as week, o.prefix from days d join own o on o.user_id = d.user_id and o.day <= d.day and o.day > d.day - 30)
    select user_id, day::varchar as day, count(*) filter (where week) as posts_7d, count(prefix) filter (where week) as originals_7d, count(distinct case when week then prefix end) as prefixes_7d, count(*) as posts_30d, count(prefix) as originals_30d, count(distinct prefix) as prefixes_30d from spans group by user_id, day""")
def author_sliding_activity(spark, sf_dir):
    """Every author's activity of the last 7 and 30 days on every day, from daily sketches."""
    e = events(spark, sf_dir)
    return screening.sliding(e.withColumn("body", _body()), "user_id", "ts", "body", F.col("k") % 5 == 0).withColumn("day", F.col("day").cast("string"))


@query(f"with {ACTIVITY_SQL} select user_id, sample_texts, unique_prefix_ratio, originals from rated")
def author_originals(spark, sf_dir):
    e = events(spark, sf_dir)
    n = e.groupBy("user_id").agg(F.count_if((F.col("k") % 5 != 0) & (F.col("event_id") % 11 != 0)).alias("originals"))
    return _screened(spark, sf_dir).join(n, "user_id").select("user_id", F.array_join("sample_texts", "|").alias("sample_texts"), "unique_prefix_ratio", "originals")


@query(f"""with {ACTIVITY_SQL} select user_id, case when user_id % 17 = 5 then 'fetch_error' else array_to_string(flags, ',') end as flags, case when user_id % 17 = 5 or list_contains(flags, 'high_volume') or list_contains(flags, 'bot') then 'reject'
    when len(flags) > 0 then 'review' else 'likely_ok' end as recommendation from flagged""")
def author_screening(spark, sf_dir):
    out = screening.with_recommendation(screening.with_flags(_screened(spark, sf_dir), screening.is_bot(("bot",), "handle", "description"), F.col("user_id") % 17 == 5))
    return out.select("user_id", F.array_join("flags", ",").alias("flags"), "recommendation")


@query(f"""with {EVENTS_SQL}, u as (select k, event_id, 0 as s from ev where event_type = 'click' union all select k, event_id, 1 from ev where event_type = 'view'),
    r as (select *, row_number() over (partition by k order by s, event_id) as rn from u) select k, event_id from r where rn = 1""")
def source_union_priority(spark, sf_dir):
    e = events(spark, sf_dir)
    return curate.union_by_priority([e.filter(f"event_type = '{t}'").select("k", "event_id") for t in ("click", "view")], "k", "event_id")


@query(f"""with c as (select *, case when turn % 2 = 0 then chr(10) || chr(9) else text end as body from conversations), r as (select conv_id as id, body as text, row_number() over (partition by conv_id order by body) as rn from c where trim(body, {WHITE_SQL}) <> '' and conv_id % 4 <> 0) select id, text from r where rn = 1""")
def candidate_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.when(F.col("turn") % 2 == 0, "\n\t").otherwise(F.col("text")).alias("text"))
    return curate.candidates(c, c.filter("id % 4 = 0"))


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) select user_id, event_id, rn::int as rn from r where rn <= 3")
def sample_n_per_author(spark, sf_dir):
    return curate.newest_per(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", 3, F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""with e as (select user_id, count(*) as n from events where event_type = 'view' group by 1), a as (select user_id, count(*) as n from events where event_type = 'click' group by 1),
    f as (select coalesce(e.user_id, a.user_id) as user_id, coalesce(e.n, 0) - coalesce(a.n, 0) as d from e full join a on e.user_id = a.user_id)
    select user_id, case when d > 0 then 'missing' else 'extra' end as side, abs(d) as n from f where d <> 0""")
def key_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return curate.key_diff(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "user_id")


@query("""select count(distinct case when quality = 1 and doc_id % 7 <> 0 and doc_id % 5 <> 1 then doc_id end) as added, count(*) filter (where quality = 0) as skipped_unlabeled,
    count(*) filter (where quality = 1 and doc_id % 7 = 0 and doc_id % 5 <> 1) as skipped_existing, count(*) filter (where quality = 1 and doc_id % 5 = 1) as rejected from labels""")
def merge_counters(spark, sf_dir):
    split = F.when(F.col("doc_id") % 5 == 1, "odd").when(F.col("doc_id") % 5 == 2, "")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("text"), F.when(F.col("quality") == 1, F.lit(True)).alias("expected"), split.alias("split"))
    old = rows.filter("cast(trim(id) as long) % 7 = 0").withColumn("id", F.trim("id"))
    return curate.merge_cases(old, rows)[1]


@query("""with old as (select doc_id::varchar as id, 'old' as text, doc_id % 2 = 0 as expected, null as bucket, 'text' as signal from labels where doc_id % 7 = 0 and quality = 1),
    new as (select doc_id::varchar as id, 'new' as text, true as expected, 'uncategorized' as bucket, case when doc_id % 4 = 0 then 'author' else 'text' end as signal from labels where quality = 1 and doc_id % 7 <> 0 and doc_id % 5 <> 1)
    select id, text, expected, bucket, signal from old union all select id, text, expected, bucket, signal from new""")
def merged_cases(spark, sf_dir):
    """Existing cases as they are, and new ones with labels: without those that exist, repeat or hold an error."""
    k = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    old = labels.filter("doc_id % 7 = 0 and quality = 1").select(k.cast("string").alias("id"), F.lit("old").alias("text"), (k % 2 == 0).alias("expected"), F.lit(None).cast("string").alias("bucket"), F.lit("text").alias("signal"))
    twice = labels.withColumn("copy", F.explode(F.when(k % 3 == 0, F.array(F.lit("new"), F.lit("zzz late"))).otherwise(F.array(F.lit("new")))))
    new = twice.select(F.concat(F.lit("\t"), k.cast("string")).alias("id"), F.col("copy").alias("text"), F.when(F.col("quality") == 1, F.lit(True)).alias("expected"), F.when(k % 5 == 1, "odd").alias("split"), F.when(k % 4 == 0, "author").alias("signal"))
    return curate.merge_cases(old, new)[0].select("id", "text", "expected", "bucket", "signal")


@query("""select l.doc_id::varchar as id, coalesce(d.text, '') as text, quality = 1 as expected, case when l.doc_id % 4 = 0 then 'author' else 'text' end as signal, case when l.doc_id % 3 = 0 then source else 'uncategorized' end as bucket,
    case when l.doc_id % 6 = 0 then 'odd' when l.doc_id % 6 = 1 then 'holdout' else 'dev' end as split, l.doc_id % 5 <> 0 as regression, l.doc_id % 8 = 0 as soft_prior, case when l.doc_id % 9 = 0 then 'n' end as note,
    case when l.doc_id % 10 = 0 then lang when l.doc_id % 10 = 1 then '' end as langs, case when l.doc_id % 6 = 0 then 'unknown split odd' end as error from labels l join documents d using (doc_id)""")
def cases_normalized(spark, sf_dir):
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), "doc_id").select(
        F.concat(F.lit("\t"), k.cast("string"), F.lit("\u00a0")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("quality") == 1).alias("expected"), F.when(k % 4 == 0, "author").otherwise("").alias("signal"),
        F.when(k % 3 == 0, F.col("source")).otherwise(F.lit(" ")).alias("bucket"), F.when(k % 6 == 0, "odd").when(k % 6 == 1, "holdout").alias("split"), F.when(k % 5 == 0, False).alias("regression"),
        F.when(k % 8 == 0, True).alias("soft_prior"), F.when(k % 9 == 0, "n").otherwise("").alias("note"), F.when(k % 10 == 0, F.array(F.col("lang"), F.lit(""), F.lit(None))).when(k % 10 == 1, F.array(F.lit(""))).alias("langs"),
    )
    out = curate.normalize_cases(raw)
    return out.select("id", "text", "expected", "signal", "bucket", "split", "regression", "soft_prior", "note", F.array_join("langs", ",").alias("langs"), "error")


@query("select doc_id as id, case when quality = 1 then true end as proposed_expected, case when toxic = 1 then 'low' else 'medium' end as proposed_confidence, case when quality = 0 then 'expected is not a boolean' end as error from labels")
def proposals_parsed(spark, sf_dir):
    answer = F.concat(F.lit('```json\n{"rationale": "r", "expected": '), F.when(F.col("quality") == 1, "true").otherwise("null"), F.when(F.col("toxic") == 1, ', "confidence": "LOW"').otherwise(""), F.lit("}\n```"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), answer.alias("response"))
    return curate.parse_proposals(rows).drop("proposed_rationale")


RESOLVED_SQL = """h as (select distinct 'h' || (c_custkey % 400)::varchar as handle from customer), p as (select 'h' || (s_suppkey % 90)::varchar as handle, min(s_suppkey) as did, count(distinct s_suppkey) as dids from supplier group by 1),
    r as (select h.handle, did, coalesce(dids, 0) as dids, case when did is null then 'unresolved' when dids > 1 then 'ambiguous' else 'ok' end as status from h left join p using (handle))"""


def _handles(spark, sf_dir):
    handles = table(spark, sf_dir, "customer").select(F.concat(F.lit("H"), (F.col("c_custkey") % 400).cast("string")).alias("handle"))
    profiles = table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), (F.col("s_suppkey") % 90).cast("string")).alias("handle"), F.col("s_suppkey").alias("did"))
    return handles, curate.resolve_handles(handles, profiles)


@query(f"with {RESOLVED_SQL} select * from r")
def handle_resolution(spark, sf_dir):
    return _handles(spark, sf_dir)[1]


@query(f"""with {RESOLVED_SQL}, l as (select distinct s_suppkey as did from supplier where s_suppkey % 3 <> 0), ok as (select did from r where status = 'ok')
    select (select count(*) from h) as handles, (select count(*) from l) as dids, (select count(*) from r where status = 'ambiguous') as ambiguous, (select count(*) from ok where did not in (select did from l)) as missing,
      (select count(*) from l where did not in (select did from ok)) as stale, false as aligned""")
def list_alignment(spark, sf_dir):
    handles, resolved = _handles(spark, sf_dir)
    return curate.alignment(handles, table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("did")), resolved)


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def volume_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("""with a as (select user_id, ts, event_id, coalesce((ts - lag(ts) over w >= interval 6 hour)::int, 1) as opened from events window w as (partition by user_id order by ts, event_id)),
    b as (select *, sum(opened) over (partition by user_id order by ts, event_id) as s from a) select user_id, min(ts) as started, count(*) as n from b group by user_id, s""")
def session_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("t", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


def scratch(spark) -> str:
    """A new folder below the shared one. On one machine a folder of its own does where none is set; on a cluster that is an error."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="townwire-")
    return f"{root}/queries/{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    from townwire.streaming.jobs import read_events

    schema = table(spark, sf_dir, "events").schema
    # the glob keeps the source a folder whether the table is one file or several
    return read_events(spark, f"{sf_dir}/events*.parquet", schema).withColumn("t", F.col("ts").cast("timestamp"))


def _run(spark, df, mode):
    from townwire.streaming.jobs import run_available

    own = scratch(spark)
    return run_available(df, f"{own}/out", mode, f"{own}/checkpoint")


@query("select distinct props->>'$.k' as k from events")
def stream_dedupe(spark, sf_dir):
    from townwire.streaming.jobs import deduplicated

    keyed = _stream(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    return _run(spark, deduplicated(keyed, "k", "t", "60 days").select("k"), "append")


@query(f"with {STATS_SQL} select user_id, strong_match_count, last_strong_at from stats")
def stream_author_counters(spark, sf_dir):
    from townwire.streaming.jobs import author_counters

    strong = _stream(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "t")
    out = _run(spark, author_counters(strong, "user_id", "t", 2, "1 hour"), "update")
    # the last update of each author; with one file there is one
    best = ix.first_wins(out, "user_id", -F.unix_micros("last_strong_at"), -F.col("strong_match_count"))
    return best.withColumn("last_strong_at", F.col("last_strong_at").cast("timestamp_ntz"))


@query(f"with {STATS_SQL} select user_id, strong_match_count, last_strong_at from stats")
def stream_author_runs(spark, sf_dir):
    """The same from rows that come late: parts that each span all of the time, landed one after the other, each read by a stream that goes on from its checkpoint."""
    from townwire.streaming.jobs import ROCKSDB, author_runs, read_events, run_available

    own = scratch(spark)
    strong = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.col("ts").cast("timestamp").alias("t"), F.pmod("event_id", F.lit(3)).alias("part"))
    provider = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        for part in range(3):
            strong.filter(F.col("part") == part).write.mode("append").parquet(f"{own}/in")
            out = run_available(author_runs(read_events(spark, f"{own}/in", strong.schema), "user_id", "t", 2, "60 days"), f"{own}/out", "update", f"{own}/checkpoint")
    finally:
        spark.conf.set(ROCKSDB[0], provider)
    return out.groupBy("user_id").agg(F.max_by("strong_match_count", F.struct("last_strong_at", "strong_match_count")).alias("strong_match_count"), F.max("last_strong_at").cast("timestamp_ntz").alias("last_strong_at"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def stream_volume(spark, sf_dir):
    from townwire.streaming.jobs import volume

    out = _run(spark, volume(_stream(spark, sf_dir), "t", "1 hour", "1 hour", "event_type"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(ORACLES["tombstone_fold"])
def stream_index(spark, sf_dir):
    """Creates and deletes appended batch by batch, then compacted."""
    from townwire.streaming.jobs import append_batches, compact

    own = scratch(spark)
    e = _stream(spark, sf_dir).filter("event_type in ('signup', 'error')")
    log = e.select(F.get_json_object("props", "$.k").alias("uri"), F.when(F.col("event_type") == "signup", "create").otherwise("delete").alias("operation"), "ts", "event_id")
    append_batches(log, f"{own}/log", f"{own}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return compact(spark, f"{own}/log").select("uri", "event_id", "ts")


def _table(spark, path, **columns):
    from pyspark.sql import types as T

    from townwire.operators.index_table import IndexTable

    return IndexTable(spark, path, columns, time=T.TimestampType())


@query(f"""with {EVENTS_SQL}, e as (select event_id, event_id::varchar as uri, ts, event_type, k from ev where event_id % 5 <> 3), old as (select *, event_id % 2 = 0 as early from e),
    r as (select uri, ts as indexed_at, case when early then null else event_type end as match_reason, 0 as like_count, k from old where not (event_id % 10 = 1 and event_id % 3 = 0))
    select uri, indexed_at, match_reason, like_count, k from r where indexed_at >= (select max(ts) from ev) - interval 7 day""")
def index_table(spark, sf_dir):
    """The index as files by day: rows without later columns, then rows with them and repeats, then deletes, then retention."""
    from pyspark.sql import types as T

    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).filter("event_id % 5 <> 3")
    rows = e.select(F.col("event_id").cast("string").alias("uri"), F.col("ts").cast("timestamp").alias("indexed_at"), "k", F.col("event_type").alias("match_reason"), "event_id")
    own = f"{scratch(spark)}/index"
    early = _table(spark, own, k=T.LongType())
    first = rows.filter("event_id % 2 = 0")
    # a table of an older kind, without the columns that came later
    first.select("uri", "indexed_at", "k", F.to_date("indexed_at").alias("indexed_on")).write.partitionBy("indexed_on").parquet(own)
    early.insert(rows)  # half of them are there
    early.remove(rows.filter("event_id % 10 = 1 and event_id % 3 = 0"))
    early.retain(e.agg(F.max("ts")).first()[0])
    return early.read().select("uri", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"), "match_reason", "like_count", "k")


@query(ORACLES["engagement_counts_asof"])
def stream_engagement(spark, sf_dir):
    """Engagement as deltas of micro-batches, merged into the index in two goes, one of them run twice."""
    from townwire.operators import index_table as it

    own = scratch(spark)
    index = _table(spark, f"{own}/index")
    index.insert(index_first_wins(spark, sf_dir).select("uri", F.col("ts").cast("timestamp").alias("indexed_at")))
    kind = F.when(F.col("event_type") == "view", "like").when(F.col("event_type") == "click", "repost")
    e = _stream(spark, sf_dir).select(kind.alias("kind"), F.get_json_object("props", "$.k").alias("subject_uri"), F.col("t").alias("ts")).filter("kind is not null")
    halves = [e.filter(half) for half in (F.dayofmonth("ts") % 2 == 0, F.dayofmonth("ts") % 2 == 1)]
    for k, half in enumerate(halves):  # two streams, as the table may be one file and so one batch
        it.engagement_deltas(half, f"{own}/deltas{k}", f"{own}/checkpoint{k}").trigger(availableNow=True).start().awaitTermination()
    deltas = [it.read_deltas(spark, f"{own}/deltas{k}").withColumn("batch", F.col("batch") * 2 + k) for k in (0, 1)]
    last = [d.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] for d in deltas]
    index.merge_counts(deltas[0], last[0])
    index.merge_counts(deltas[0].unionByName(deltas[1]), max(last))
    index.merge_counts(deltas[0].unionByName(deltas[1]), max(last))
    return index.read().select("uri", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"), "like_count", "repost_count")


PAIRS_SQL = lambda src, key: rf"""select {key}, l[i] as a, l[i + 1] as b from (select {key}, l, unnest(range(1, len(l))) as i from (select {key}, regexp_extract_all(lower({NORM}), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]') as l from {src}))
      where regexp_matches(l[i], '^[\p{{L}}\p{{N}}_]') and regexp_matches(l[i + 1], '^[\p{{L}}\p{{N}}_]')"""  # noqa: E731


@query(rf"""with lex as (select distinct a || ' ' || b as surface from ({PAIRS_SQL("conversations", "conv_id")})), seen as (select distinct doc_id, a || ' ' || b as surface from ({PAIRS_SQL("documents", "doc_id")})),
    r as (select doc_id, surface, row_number() over (partition by doc_id order by length(surface) desc, surface) as rn from seen join lex using (surface)) select doc_id, surface from r where rn = 1""")
def lexicon_automaton(spark, sf_dir):
    """The longest pair of neighbouring words of any conversation that a document holds: a lexicon that grows with the tables."""
    from townwire.operators.automaton import longest_hits

    tokens = F.regexp_extract_all(F.lower(tx.normalize(F.col("text"))), F.lit(lexicon.TOKEN), F.lit(0))
    cut = table(spark, sf_dir, "conversations").select(tokens.alias("l"))
    pairs = cut.select(F.explode(F.arrays_zip(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))).alias("a"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("b"))).alias("p")).select("p.*")
    word = lambda c: F.col(c).rlike(r"^[\p{L}\p{N}_]")
    surfaces = pairs.filter(word("a") & word("b")).select(F.concat_ws(" ", "a", "b").alias("surface")).distinct()
    lex = surfaces.select("surface", F.col("surface").alias("entity_id"), F.lit("local").alias("region"), F.lit(0).alias("ord"))
    texts = documents(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("t"))
    return longest_hits(texts, lex, "doc_id", "t", folder=scratch(spark)).select("doc_id", "surface")


@query("""with n as (select max(ts) + interval 200 second as now from events) select event_type, epoch(now - max(ts))::double as lag_s, epoch(now - max(ts)) < 300 as healthy from events, n group by event_type, now""")
def lag_health(spark, sf_dir):
    from townwire.streaming import jobs

    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") + F.expr("INTERVAL 200 SECOND")).alias("now"))
    return jobs.lag_health(e.crossJoin(F.broadcast(now)), "ts", F.col("now"), "event_type", "now").drop("now")  # one row


@query(f"""with {EVENTS_SQL}, m as (select max(ts) as now from ev) select event_id from ev, m where event_type <> 'view' or now - ts <= interval 120 second""")
def shed_engagement(spark, sf_dir):
    from townwire.sources.commits import shed

    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    return shed(e.crossJoin(F.broadcast(now)), F.col("now"), F.col("ts").cast("timestamp"), F.col("event_type") == "view").select("event_id")  # one row


from townwire.plans import rule_queries, source_queries  # noqa: E402, F401  register the queries of the whole rule pack and of files
