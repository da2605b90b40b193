"""The whole rule pack over the lines of all documents, its parts, author history, and the live path, each with its SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from townwire.functions import text as tx
from townwire.operators import cascade, curate, evaluate, live, rules
from townwire.operators.gates import FeedConfig
from townwire.operators.lexicon import Lexicon
from townwire.operators.linear import LinearModel, features
from townwire.packs import HERE
from townwire.plans import rule_sql as rs
from townwire.plans.registry import query, scratch
from townwire.plans.tables import documents
from townwire.sources.commits import POST


@cache
def pack() -> rules.RulePack:
    return rules.load_pack(HERE / "prose_full.json")


@cache
def lexicon() -> Lexicon:
    return Lexicon.load(HERE / "prose_full_lexicon.json")


@cache
def model() -> LinearModel:
    return LinearModel.load(HERE / "prose_full_model.json")


DIDS, HANDLES = ("src1",), ("src2.x.example",)
CONFIG = FeedConfig(prior_min_strong=2, prior_days=1, muted=("inger",), retention_days=20)

LINES_SQL = """lines as (select doc_id * 100000 + pos as uri, nullif(case when (doc_id + pos) % 17 = 0 then '@ha.example is ' || line when (doc_id + pos) % 17 = 1 then 'to me@st.example ' || line when (doc_id + pos) % 17 = 2 then line || ' @nd' else line end, '') as text, lang, source, doc_id, pos from
      (select doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from documents)),
    src as (select uri, case when uri % 53 = 0 then null else text end as text, case when doc_id % 11 = 0 then 'Photo of nd' end as alt_text, case when doc_id % 5 = 0 then [lang, 'en'] else [lang] end as langs,
      source as author_did, source || '.x.example' as author_handle, doc_id % 4 = 0 as soft_prior, doc_id, pos,
      timestamp '2024-01-01' + to_minutes(((doc_id * 37 + pos * 11) % 40000)::bigint) as ts from lines)"""


def lines(spark, sf_dir):
    """Every line of every document as a post of its source."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    # some lines mention a handle, or hold an address, whose words are places
    k = (F.col("doc_id") + F.col("pos")) % 17
    d = d.withColumn("line", F.when(k == 0, F.concat(F.lit("@ha.example is "), "line")).when(k == 1, F.concat(F.lit("to me@st.example "), "line")).when(k == 2, F.concat("line", F.lit(" @nd"))).otherwise(F.col("line")))
    uri = F.col("doc_id") * 100_000 + F.col("pos")
    minutes = (F.col("doc_id") * 37 + F.col("pos") * 11) % 40_000
    return d.select(
        uri.alias("uri"), F.when((uri % 53 != 0) & (F.col("line") != ""), F.col("line")).alias("text"), F.when(F.col("doc_id") % 11 == 0, "Photo of nd").alias("alt_text"),
        F.when(F.col("doc_id") % 5 == 0, F.array("lang", F.lit("\tEN\u00a0"))).otherwise(F.array("lang")).alias("langs"), F.col("source").alias("author_did"),
        F.concat(F.col("source"), F.lit(".X.example")).alias("author_handle"), (F.col("doc_id") % 4 == 0).alias("soft_prior"), "doc_id", "pos",
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))).alias("ts"),
    )


SIG_SQL = f"{LINES_SQL}, {rs.signals(pack(), lexicon(), 'src')}"
VERDICT_SQL = f"with {SIG_SQL}, v as (select uri, {rs.reason(pack(), model(), 'soft_prior', DIDS, HANDLES)} as reason from sig) select uri, reason, {rs.matches(pack(), cascade.KEEP_REASONS, cascade.KEEP_PREFIXES)} as matched from v"


@query(VERDICT_SQL)
def cascade_full_verdicts(spark, sf_dir):
    dids, handles = spark.createDataFrame([(d,) for d in DIDS], "did string"), spark.createDataFrame([(h,) for h in HANDLES], "handle string")
    return cascade.decide(lines(spark, sf_dir), pack(), lexicon(), model(), dids, handles).select("uri", "reason", "matched")


@query(f"with f as ({VERDICT_SQL}) select matched, split_part(reason, ':', 1) as reason_class, count(*) as n, count(distinct reason) as reasons, count(*) filter (where {rs.matches(pack(), cascade.STRONG_REASONS, cascade.STRONG_PREFIXES)}) as strong from f group by all")
def cascade_full_classes(spark, sf_dir):
    v = cascade_full_verdicts(spark, sf_dir)
    strong = cascade.is_strong_reason(F.col("reason"), pack())
    return v.groupBy("matched", cascade.reason_class(F.col("reason")).alias("reason_class")).agg(F.count("*").alias("n"), F.count_distinct("reason").alias("reasons"), F.count_if(strong).alias("strong"))


FLAGS = ("strong", "hard_negative", "context", "blocks_strong", "town_local", "event_cue", "venue", "region_hint", "byline", "other_place")


@query(f"with {SIG_SQL} select uri, {', '.join('context' if k == 'context' else f'{rs.has(pack().classes[k])} as {k}' for k in FLAGS)}, array_to_string(places, ' ') as places, array_to_string(list_sort(micro), ' ') as micro, array_to_string(list_sort(several), ' ') as several, term from sig")
def rule_class_hits(spark, sf_dir):
    d, read = rules.reading(lines(spark, sf_dir), tx.combine(F.col("text"), F.col("alt_text")))
    d = rules.once(d, **{k: cascade.in_bare_text(read, lambda r: pack().has("context", r)) if k == "context" else pack().has(k, read) for k in FLAGS}, found=F.array_sort(cascade.in_bare_text(read, lambda r: pack().all_of("ambiguous", r))), near=F.array_sort(cascade._micro(pack(), read)))
    several, term = F.array_sort(cascade.distinct_places(F.col("found"), pack().excluded)), cascade.chosen_term(F.col("found"), pack().excluded)
    texts = {k: F.array_join(c, " ") for k, c in (("places", F.col("found")), ("micro", F.col("near")), ("several", several))}
    return d.select("uri", *FLAGS, *(c.alias(k) for k, c in texts.items()), term.alias("term"))


@query(f"with {SIG_SQL} select uri, {', '.join(f'{rs.conflict(c)} as {k}' for k, c in pack().conflicts.items())} from sig")
def conflict_hits(spark, sf_dir):
    d, read = rules.reading(lines(spark, sf_dir), tx.combine(F.col("text"), F.col("alt_text")))
    d, read = rules.with_pieces(d, read, pack().conflicts.values())
    d = rules.once(d, context=pack().anchored(read))
    return d.select("uri", *(c.condition(read, F.col("author_handle"), F.col("context")).alias(k) for k, c in pack().conflicts.items()))


@query(f"with {SIG_SQL} select uri, {', '.join(f'({x})::double as {k}' for k, x in rs.features(pack(), 'soft_prior').items())}, {rs.score(pack(), model(), 'soft_prior')} as score from sig")
def model_features(spark, sf_dir):
    d, read = rules.reading(lines(spark, sf_dir), tx.combine(F.col("text"), F.col("alt_text")))
    bare = lambda look: cascade.in_bare_text(read, look)
    has = {"_place": bare(lambda r: pack().has("ambiguous", r)), "_event": pack().has("event_cue", read), "_context": bare(lambda r: pack().has("context", r))}
    d = rules.once(d, places=bare(lambda r: pack().all_of("ambiguous", r)), micro=cascade._micro(pack(), read), **has, _venue=pack().first_of("venue", read) != "")
    own = F.coalesce(cascade.chosen_term(F.col("places"), pack().excluded).isin(*pack().own_reasons), F.lit(False))
    f = features(micro=F.col("micro"), place=F.col("_place"), event=F.col("_event"), venue=F.col("_venue"), context=F.col("_context"), own_term=own, prior=F.col("soft_prior"))
    return d.select("uri", *(c.alias(k) for k, c in f.items()), model().score(f).alias("score"))


@query(f"""with {SIG_SQL}, v as (select author_did, {rs.reason(pack(), model(), 'soft_prior')} as reason from sig) select author_did, count(*) filter (where starts_with(reason, 'lang_non_local')) as gated, count(*) as n from v group by author_did""")
def language_gate_counts(spark, sf_dir):
    v = cascade.decide(lines(spark, sf_dir), pack(), lexicon(), model())
    return v.groupBy("author_did").agg(F.count_if(cascade.reason_class(F.col("reason")) == "lang_non_local").alias("gated"), F.count("*").alias("n"))


def _history_sql(src: str, where: str = "true") -> str:
    """CTEs to h: verdicts with the author's history, as columns reason, matched, strong_before, soft."""
    return f"""two as (select *, {rs.reason(pack(), model(), 'false')} as r0, {rs.reason(pack(), model(), 'true')} as r1 from {src} where {where}),
    flag as (select *, {rs.matches(pack(), cascade.STRONG_REASONS, cascade.STRONG_PREFIXES, 'r0')} as strong_match from two),
    a as (select *, last_value(case when strong_match then ts end ignore nulls) over (partition by author_did order by ts, uri rows between unbounded preceding and 1 preceding) as last_at from flag),
    b as (select *, sum((strong_match and (last_at is null or ts - last_at > interval 1 day))::int) over (partition by author_did order by ts, uri) as session from a),
    c as (select *, sum(strong_match::int) over (partition by author_did, session order by ts, uri) as total from b),
    e as (select *, coalesce(lag(total) over (partition by author_did order by ts, uri), 0)::bigint as strong_before from c),
    f as (select *, strong_before >= 2 and coalesce(ts - last_at <= interval 1 day, false) as soft from e),
    g as (select *, case when soft then r1 else r0 end as reason from f),
    h as (select *, {rs.matches(pack(), cascade.KEEP_REASONS, cascade.KEEP_PREFIXES)} as matched from g)"""


@query(f"with {SIG_SQL}, {_history_sql('sig')} select uri, reason, matched, strong_before, soft as soft_prior from h")
def prior_cascade(spark, sf_dir):
    out = live.decide_with_history(lines(spark, sf_dir), pack(), CONFIG, path=f"{scratch(spark)}/verdicts", lexicon=lexicon(), model=model())
    return out.select("uri", "reason", "matched", "strong_before", "soft_prior")


# --- the live path over commits made of all lines -------------------------------------------

LIVE_SQL = f"""{LINES_SQL.replace("src as (", "base as (")},
    src as (select 'at://did:' || author_did || '/{POST}/' || uri as uri, coalesce(text, '') as text, coalesce(alt_text, '') as alt_text, langs, 'did:' || author_did as author_did, null::varchar as author_handle,
      pos % 7 = 3 as reply, case when doc_id % 13 = 0 then ts - interval 3 day else ts - interval 1 hour end as created_at, ts, doc_id, pos from base),
    {rs.signals(pack(), lexicon(), 'src')},
    opened as (select * from sig where not reply and not (ts - created_at > interval 1 day) and not contains(lower(text || ' ' || alt_text), 'inger')),
    {_history_sql('opened')},
    gone as (select uri, ts + interval 2 hour as gone_at from src where doc_id % 9 = 4),
    kept as (select h.* from h left join gone using (uri) where matched and gone.uri is null and ts >= (select max(case when doc_id % 9 = 4 then ts + interval 2 hour else ts end) from src) - interval 20 day),
    liked as (select 'at://did:' || author_did || '/{POST}/' || uri as uri, k, ts + to_minutes((k * 7 - 30)::bigint) as liked_at from base, (select unnest(range(12)) as k) where k <= pos % 12)
    """


def commit_lines(spark, sf_dir):
    """All lines of all documents as commits in JSON lines: posts, some deleted two hours later, with likes and reposts before and after."""
    from townwire.sources import commits as cm

    p = lines(spark, sf_dir)
    did = F.concat(F.lit("did:"), F.col("author_did"))
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    after = lambda minutes: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    created = F.when(F.col("doc_id") % 13 == 0, F.col("ts") - F.expr("INTERVAL 3 DAY")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    embed = F.when(F.col("alt_text").isNotNull(), F.struct(F.array(F.struct(F.col("alt_text").alias("alt"))).alias("images")))
    reply = F.when(F.col("pos") % 7 == 3, F.struct(F.struct(F.lit("at://root").alias("uri")).alias("parent"), F.struct(F.lit("at://root").alias("uri")).alias("root")))
    record = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), "langs", embed.alias("embed"), reply.alias("reply"))

    def commit(df, author, time, collection, operation, rkey, made):
        body = F.struct(F.lit(collection).alias("collection") if isinstance(collection, str) else collection.alias("collection"), F.lit(operation).alias("operation"), rkey.alias("rkey"), F.lit("c").alias("cid"), made.alias("record"))
        return df.select(F.to_json(F.struct(F.lit("commit").alias("kind"), author.alias("did"), micros(time).alias("time_us"), body.alias("commit"))).alias("value"))

    key = F.col("uri").cast("string")
    uri = F.concat(F.lit("at://"), did, F.lit(f"/{cm.POST}/"), key)
    posts = commit(p, did, F.col("ts"), cm.POST, "create", key, record)
    deletes = commit(p.filter("doc_id % 9 = 4"), did, after(F.lit(120)), cm.POST, "delete", key, F.lit(None).cast("struct<text:string>"))
    fans = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pos") % 12)))
    liked = commit(fans, F.lit("did:fan"), after(F.col("k") * 7 - 30), F.when(F.col("k") % 3 == 0, cm.REPOST).otherwise(cm.LIKE), "create", F.concat(key, F.lit("-"), F.col("k").cast("string")), F.struct(F.struct(uri.alias("uri")).alias("subject")))
    return posts.unionByName(deletes).unionByName(liked)


@query(f"""with {LIVE_SQL} select kept.uri, kept.author_did, reason as match_reason, created_at, ts as indexed_at, count(k) filter (where k % 3 <> 0 and liked_at >= ts) as like_count, count(k) filter (where k % 3 = 0 and liked_at >= ts) as repost_count
    from kept left join liked on liked.uri = kept.uri group by all""")
def live_index(spark, sf_dir):
    from townwire.sources import commits as cm

    own = scratch(spark)
    events = cm.landed(cm.decode(cm.parsed(commit_lines(spark, sf_dir))), f"{own}/events")
    posts = cm.posts(events)
    now = events.filter("kind = 'post'").agg(F.timestamp_micros(F.max("time_us")).alias("now"))
    out = live.live_index(posts, cm.engagement(events), pack(), CONFIG, path=own, lexicon=lexicon(), model=model())
    recent = live.index.retained(out.crossJoin(F.broadcast(now)), F.col("now"), CONFIG.retention_days)  # one row
    return recent.select("uri", "author_did", "match_reason", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "indexed_at")), "like_count", "repost_count")


BACKFILL_SQL = f"""{LINES_SQL.replace("src as (", "base as (")},
    src as (select 'at://' || uri as uri, coalesce(text, '') as text, ''::varchar as alt_text, langs, 'did:' || author_did as author_did, null::varchar as author_handle, pos % 7 = 3 as reply, ts, pos % 5 = 4 as bad, doc_id % 6 = 0 as known from base),
    {rs.signals(pack(), lexicon(), 'src')},
    early as (select *, case when bad then 'bad_payload' when ts < timestamp '2024-01-03' or ts > timestamp '2024-01-25' then 'outside' when known then 'exists' when reply then 'skipped:reply_ignored'
      when contains(lower(text || ' ' || alt_text), 'inger') then 'skipped:muted' end as outcome from sig),
    {_history_sql('early', 'outcome is null')}"""


def _backfill(spark, sf_dir):
    from townwire.sources import commits as cm
    from townwire.sources import files

    p = lines(spark, sf_dir)
    reply = F.when(F.col("pos") % 7 == 3, F.struct(F.struct(F.lit("u").alias("uri")).alias("parent"), F.struct(F.lit("u").alias("uri")).alias("root")))
    created = F.when(F.col("pos") % 5 != 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    record = F.struct(F.coalesce("text", F.lit("")).alias("text"), created.alias("createdAt"), "langs", reply.alias("reply"))
    author = F.struct(F.concat(F.lit("did:"), "author_did").alias("did"), F.lit("h").alias("handle"))
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("at://"), F.col("uri").cast("string")).alias("uri"), author.alias("author"), record.alias("record"))).alias("posts")))
    views = files.search_posts(p.select(F.from_json(payload, files.SEARCH).alias("p")).select("p.*"))
    posts = cm.posts(files.post_views_to_events(views), "status")
    existing = p.filter("doc_id % 6 = 0").select(F.concat(F.lit("at://"), F.col("uri").cast("string")).alias("uri"))
    bound = lambda day: F.lit(day).cast("timestamp")
    return live.backfill(posts, existing, pack(), CONFIG, bound("2024-01-03"), bound("2024-01-25"), path=scratch(spark), lexicon=lexicon(), model=model())


@query(f"with {BACKFILL_SQL} select uri, reason as match_reason, ts as created_at, ts as indexed_at from h where matched")
def backfill_rows(spark, sf_dir):
    return _backfill(spark, sf_dir)[0].select("uri", "match_reason", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "indexed_at")))


@query(f"with {BACKFILL_SQL}, o as (select coalesce(outcome, '') as outcome from early where outcome is not null union all select case when matched then 'indexed' else 'skipped:' || reason end from h) select outcome, count(*) as n from o group by all")
def backfill_outcomes(spark, sf_dir):
    from townwire.operators.audit import outcome_counts

    return outcome_counts(_backfill(spark, sf_dir)[1], "outcome")


@query(f"with {SIG_SQL}, v as (select uri, {rs.reason(pack(), model(), 'doc_id % 3 = 0 and doc_id % 2 = 0')} as reason from sig) select uri, reason from v")
def case_prior_override(spark, sf_dir):
    p = lines(spark, sf_dir).withColumn("named", F.when(F.col("doc_id") % 2 == 0, F.col("author_did")))
    p = p.withColumn("soft_prior", evaluate.effective_prior(F.col("doc_id") % 3 == 0, F.col("named")))
    return cascade.decide(p, pack(), lexicon(), model()).select("uri", "reason")


@query(rf"with {LINES_SQL}, s as (select lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as form, uri from src), r as (select form, min(uri) as uri from s group by form) select form, uri from r")
def surface_forms(spark, sf_dir):
    p = lines(spark, sf_dir).select("uri", tx.surface_form(F.coalesce("text", F.lit(""))).alias("form"))
    return curate.ordered_distinct(p, "form", "uri").select("form", "uri")
