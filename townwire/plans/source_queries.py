"""Landed files and payloads: written from the given tables, read back by the sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from townwire.functions import text as tx
from townwire.functions.embeds import alt_text, merged_alt_text
from townwire.functions.times import event_time, in_window, parse_iso
from townwire.operators import curate, evaluate, ranking
from townwire.operators import index as ix
from townwire.operators.linear import LinearModel
from townwire.plans.registry import INDEX_SQL, query, scratch
from townwire.plans.rule_sql import WHITE_SQL, without_handles
from townwire.plans.tables import events, index, table
from townwire.sources import commits as cm
from townwire.sources import files


def landed(spark, lines, column: str = "value") -> str:
    """One string column as text files in the shared folder."""
    path = f"{scratch(spark)}/lines"
    lines.select(F.col(column).alias("value")).write.text(path)
    return path


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumn("k", F.col("doc_id"))





def _lines(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 7
    good = F.to_json(F.struct(key.alias("id"), (F.col("quality") == 1).alias("expected"), F.lit('a "quoted" text').alias("text")))
    line = F.when(k == 0, F.concat(F.lit("["), key, F.lit("]"))).when(k == 1, F.concat(F.lit("\t\u2003# "), key)).when(k == 2, F.lit(" \t\u00a0 ")).when(k == 3, F.concat(F.lit("{broken "), key)).when(k == 4, F.concat(F.lit("\t\u00a0"), good, F.lit("\x1c"))).otherwise(good)
    return landed(spark, table(spark, sf_dir, "labels").select(line.alias("value")))


@query("""select count(*) filter (where doc_id % 7 > 3) as good, count(*) filter (where doc_id % 7 in (0, 1, 3)) as bad, count(distinct case when doc_id % 7 > 3 then doc_id end) as ids, count(*) filter (where doc_id % 7 > 3 and quality = 1) as expected from labels""")
def jsonl_lines(spark, sf_dir):
    df = files.read_jsonl(spark, _lines(spark, sf_dir), files.CASE, strict=False)
    good = F.col("error").isNull()
    return df.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.count_distinct(F.when(good, F.col("id"))).alias("ids"), F.count_if(good & F.col("expected")).alias("expected"))


@query("""select doc_id::varchar as id, quality = 1 as expected, 'a "quoted" text' as text, false as failed from labels where doc_id % 7 > 3 union all select null, null, null, true from labels where doc_id % 7 in (0, 3)""")
def labelled_lines(spark, sf_dir):
    return files.read_labelled(spark, _lines(spark, sf_dir), strict=False).select("id", "expected", "text", F.col("error").isNotNull().alias("failed"))


@query(f"""with l as (select trim(case when c_custkey % 5 = 0 then chr(9) || '# ' || c_name when c_custkey % 5 = 1 then chr(9) when c_custkey % 5 = 2 then chr(160) || c_mktsegment || ' # kept' || chr(11) else upper(c_mktsegment) || chr(9) end, {WHITE_SQL}) as v from customer)
    select distinct lower(v) as key from l where v <> '' and not starts_with(v, '#')""")
def list_file_keys(spark, sf_dir):
    k = F.col("c_custkey") % 5
    line = F.when(k == 0, F.concat(F.lit("\t# "), "c_name")).when(k == 1, F.lit("\t")).when(k == 2, F.concat(F.lit("\u00a0"), "c_mktsegment", F.lit(" # kept\x0b"))).otherwise(F.concat(F.upper("c_mktsegment"), F.lit("\t")))
    return files.read_list(spark, landed(spark, table(spark, sf_dir, "customer").select(line.alias("value"))), lower=True)


@query("select doc_id::varchar as id, case when toxic = 1 then 'n' end as note, quality = 1 as expected from labels")
def jsonl_round_trip(spark, sf_dir):
    """Written as JSON lines that keep nulls, and as one array; both read back."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "n").alias("note"), (F.col("quality") == 1).alias("expected"))
    own = scratch(spark)
    files.write_jsonl(rows, f"{own}/lines")
    files.write_cases(files.read_jsonl(spark, f"{own}/lines", files.CASE).select("id", "note", "expected"), f"{own}/array")
    return files.read_cases(spark, f"{own}/array").select("id", "note", "expected")


CLIP = lambda c: f"rtrim(substr(trim({c}, {WHITE_SQL}), 1, 320), {WHITE_SQL})"


#: Quotes in quotes of the rows whose page_id is divisible by 3.
QUOTES = 5


@query(f"""select page_id, array_to_string(list_filter([{CLIP('title')}, {CLIP('url')}, {CLIP('html')}, {CLIP('m')}, {', '.join(CLIP(f'q{i}') for i in range(QUOTES))}, {CLIP('qi')}], lambda x: coalesce(x, '') <> ''), ' ') as alt,
      {CLIP('title')} || case when trim(title) <> '' and {CLIP('title')} <> trim(url) then ' ' || trim(url) else '' end as merged
    from (select *, regexp_extract(html, '<title>(.*?)</title>', 1) as title, case when page_id % 2 = 0 then substr(html, 200, 700) end as m,
        case when page_id % 3 = 0 then chr(10) || chr(9) || chr(8195) || substr(html, 300, 900) when page_id % 3 = 1 then url end as q0,
        {' '.join(f"case when page_id % 3 = 0 then substr(html, {300 + 100 * i}, 350) end as q{i}," for i in range(1, QUOTES))}
        case when page_id % 3 = 0 then substr(html, 100, 400) end as qi from pages where html is not null)""")
def alt_text_cases(spark, sf_dir):
    """Embeds of every kind, quotes five deep, as JSON text that is read back."""
    p = table(spark, sf_dir, "pages").filter("html is not null").withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1))
    k = F.col("page_id")
    quoted = F.struct(F.array(F.struct(F.substring("html", 100, 400).alias("alt"))).alias("images"))
    for i in reversed(range(QUOTES)):
        text = F.substring("html", 300 + 100 * i, 350) if i else F.concat(F.lit("\n\t\u2003"), F.substring("html", 300, 900))
        inner = F.struct(text.alias("text"), quoted.alias("embed"))
        quoted = F.struct(F.struct(inner.alias("record")).alias("record"))
    value = F.struct(F.col("url").alias("text"))
    embed = F.struct(
        F.array(F.struct(F.col("title").alias("alt"))).alias("images"), F.struct(F.col("url").alias("title"), F.col("html").alias("description")).alias("external"),
        F.when(k % 2 == 0, F.struct(F.array(F.struct(F.substring("html", 200, 700).alias("alt"))).alias("images"))).alias("media"),
        F.struct(F.when(k % 3 == 0, inner).alias("record"), F.when(k % 3 != 2, value).alias("value")).alias("record"),
    )
    read = p.select("page_id", "title", "url", F.try_parse_json(F.to_json(embed)).alias("e"))
    return read.select("page_id", alt_text(F.col("e")).alias("alt"), merged_alt_text(tx.clip(F.col("title")), F.trim("url"), tx.clip(F.col("title"))).alias("merged"))


@query("""select event_id, case when event_id % 5 in (0, 1) then ts when event_id % 5 = 2 then ts - interval 2 hour end as parsed, case when event_id % 3 > 0 then ts end as at,
    coalesce(case when event_id % 5 in (0, 1) then ts when event_id % 5 = 2 then ts - interval 2 hour end between timestamp '2024-01-10' and timestamp '2024-01-20', false) as inside from events""")
def times_parsed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(F.lit(" "), iso, F.lit("+00:00"))).when(k == 2, F.concat(iso, F.lit("+02:00"))).when(k == 3, F.lit("soon"))
    d = e.select("event_id", parse_iso(text).alias("p"), event_time(F.when(F.col("event_id") % 3 == 0, -micros).otherwise(micros)).alias("a"))
    bound = lambda day: F.lit(day).cast("timestamp")
    return d.select("event_id", F.col("p").cast("timestamp_ntz").alias("parsed"), F.col("a").cast("timestamp_ntz").alias("at"), in_window(F.col("p"), bound("2024-01-10"), bound("2024-01-20")).alias("inside"))


@query(rf"""select doc_id, {without_handles("'see @' || source || '.example-x and me@' || source || '.example ' || lang || ' ' || coalesce(text, '') || ' @' || lang")} as bare from documents""")
def handles_stripped(spark, sf_dir):
    text = F.concat(F.lit("see @"), "source", F.lit(".example-x and me@"), "source", F.lit(".example "), "lang", F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" @"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", tx.without_handles(text).alias("bare"))


def _view(d):
    """Documents as hydrated posts."""
    k = F.col("doc_id")
    record = F.struct(
        F.col("text"), F.when(k % 5 == 0, F.lit("soon")).otherwise(F.lit("2024-01-02T03:04:05Z")).alias("createdAt"), F.array("lang").alias("langs"),
        F.when(k % 4 == 1, F.struct(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("uri")).alias("parent"), F.struct(F.lit("r").alias("uri")).alias("root"))).alias("reply"),
    )
    author = F.struct(F.when(k % 7 != 0, F.concat(F.lit("did:"), "source")).alias("did"), F.concat("source", F.lit(".Example")).alias("handle"))
    return F.struct(F.concat(F.lit("at://"), k.cast("string")).alias("uri"), F.when(k % 3 == 0, "c").alias("cid"), author.alias("author"), F.when(k % 6 != 0, record).alias("record"))


@query("""select 'at://' || doc_id as uri, case when doc_id % 3 = 0 then 'c' else '' end as cid, case when doc_id % 7 <> 0 then 'did:' || source end as author_did, case when doc_id % 6 <> 0 and doc_id % 5 <> 0 then 1704164645000000 end as time_us,
    case when doc_id % 7 <> 0 and doc_id % 6 <> 0 and doc_id % 5 <> 0 then 'ok' else 'bad_payload' end as status from documents""")
def post_view_events(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    payload = F.to_json(F.struct(F.lit("q").alias("query"), F.array(_view(d)).alias("posts")))
    views = files.search_posts(d.select(F.from_json(payload, files.SEARCH).alias("p")).select("p.*"))
    return files.post_views_to_events(views).select("uri", "cid", "author_did", "time_us", "status")


@query("""select 'at://' || doc_id as id, coalesce(case when doc_id % 6 <> 0 then text end, '') as text, null::boolean as expected, 'pool' as bucket, case when doc_id % 6 <> 0 then lang end as langs, lower(source || '.Example') as handle
    from documents where doc_id % 4 <> 2 and doc_id % 3 <> 1 and (doc_id % 2 = 0 or doc_id % 7 <> 0)""")
def author_feed_candidates(spark, sf_dir):
    """Author feeds without reposts and other authors' posts, as candidates to label."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    actor = F.when(k % 3 == 1, F.lit("nobody")).when(k % 2 == 0, F.upper(F.concat("source", F.lit(".example")))).otherwise(F.concat(F.lit("DID:"), "source"))
    reason = F.when(k % 4 == 2, F.struct(F.lit("repost").alias("$type")))
    payload = F.to_json(F.struct(actor.alias("actor"), F.array(F.struct(_view(d).alias("post"), reason.alias("reason"))).alias("feed")))
    own = files.author_feed_posts(d.select(F.from_json(payload, files.AUTHOR_FEED).alias("p")).select("p.*"))
    return files.candidate_rows(own, "pool").select("id", "text", "expected", "bucket", F.array_join("langs", ",").alias("langs"), F.lower("author_handle").alias("handle"))


@query("select doc_id as page, pos - 1 as position, 'at://' || doc_id || '/' || pos as uri from (select doc_id, unnest(range(1, 4)) as pos from documents)")
def feed_page_uris(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    posts = F.transform(F.lit([1, 2, 3]), lambda i: F.struct(F.concat(F.lit("at://"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string")).alias("post")))
    skeleton = d.select(F.from_json(F.to_json(F.struct(posts.alias("feed"))), files.SKELETON).alias("p")).select("p.*")
    return files.feed_uris(skeleton).select(F.split("uri", "/")[2].cast("long").alias("page"), F.col("position").cast("long").alias("position"), "uri")


@query("""select 'at://did:' || source || '/app.bsky.feed.post/' || doc_id as uri, case when doc_id % 4 = 1 then 'p' || doc_id end as parent, case when doc_id % 4 = 1 then 'r' end as root from documents where doc_id % 9 not in (1, 2, 3)""")
def reply_uris(spark, sf_dir):
    """Commit lines of which some are cut off, empty or lists: those are skipped."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    body = F.struct(F.lit(cm.POST).alias("collection"), F.col("doc_id").cast("string").alias("rkey"), F.lit("create").alias("operation"), _view(d)["record"].alias("record"))
    record = F.when(F.col("doc_id") % 6 == 0, F.to_json(F.struct(F.lit("commit").alias("kind"), F.concat(F.lit("did:"), "source").alias("did"), F.lit(1).alias("time_us"), body.dropFields("record").alias("commit"))))
    line = F.coalesce(record, F.to_json(F.struct(F.lit("commit").alias("kind"), F.concat(F.lit("did:"), "source").alias("did"), F.lit(1).alias("time_us"), body.alias("commit"))))
    bad = d.select(F.when(k == 1, F.substring(line, 1, 40)).when(k == 2, F.lit("")).when(k == 3, F.lit("[1, 2]")).otherwise(line).alias("value"))
    return cm.posts(cm.decode(cm.parsed(bad))).select("uri", F.col("reply_parent").alias("parent"), F.col("reply_root").alias("root"))


@query("""select count(*) filter (where doc_id % 9 = 1) + count(*) filter (where doc_id % 9 = 2) as malformed from documents""")
def malformed_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    lines = d.select(F.when(k == 1, '{"kind": ').when(k == 2, "").otherwise('{"kind": "commit"}').alias("value"))
    return cm.malformed(lines).agg(F.count("*").alias("malformed"))


@query("""with p as (select doc_id as id, doc_id % 3 <> 0 as asked, doc_id % 5 = 0 as bad, quality = 1 as said, case when toxic = 1 then 'x' when doc_id % 4 = 0 then '' else chr(9) end as had, case when doc_id % 2 = 0 then 'high' else 'low' end as conf, case when quality = 1 then 'because' else '' end as why, doc_id % 7 = 0 as before from labels)
    select id, case when asked and not bad then said else before end as expected, case when asked and not bad then said end as proposed_expected, case when asked then 'llm' end as proposed_by, asked as needs_human_confirm,
      case when not asked then nullif(had, '') when bad then trim(had || ' | llm error: expected is not a boolean', ' |') when trim(had, chr(9)) <> '' then trim(had || ' | llm propose expected=' || case when said then 'True' else 'False' end || ' (' || conf || '): ' || why, ' |')
        else 'llm propose expected=' || case when said then 'True' else 'False' end || ' (' || conf || '): ' || why end as note from p""")
def proposals_attached(spark, sf_dir):
    k = _labels(spark, sf_dir)
    note = F.when(F.col("toxic") == 1, "x").when(F.col("doc_id") % 4 == 0, "").otherwise("\t")
    rows = k.select(F.col("doc_id").alias("id"), note.alias("note"), (F.col("doc_id") % 7 == 0).alias("expected"))
    said = F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1)
    answer = F.to_json(F.struct(said.alias("expected"), F.when(F.col("quality") == 1, "\t because ").otherwise("").alias("rationale"), F.when(F.col("doc_id") % 2 == 0, "HIGH").otherwise("low").alias("confidence")))
    proposals = curate.parse_proposals(k.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), answer.alias("response")))
    return curate.attach_proposals(rows, proposals).select("id", "note", "expected", "proposed_expected", "proposed_by", "needs_human_confirm")


@query(f"with {INDEX_SQL} select uri, indexed_at from idx order by indexed_at desc, uri desc limit 50")
def newest_first(spark, sf_dir):
    return files.newest(index(spark, sf_dir), 50).select("uri", "indexed_at")


@query(f"with {INDEX_SQL} (select uri, 'over' as asked from idx order by created_at desc nulls last, indexed_at desc, cid desc, uri desc limit 100) union all (select uri, 'under' from idx order by created_at desc nulls last, indexed_at desc, cid desc, uri desc limit 1) union all (select uri, 'none' from idx order by created_at desc nulls last, indexed_at desc, cid desc, uri desc limit 20)")
def page_sizes(spark, sf_dir):
    mode, rows = ranking.rankings()["created"], index(spark, sf_dir)
    pages = [mode.page(rows, limit=n).select("uri", F.lit(asked).alias("asked")) for asked, n in (("over", 1000), ("under", -3), ("none", None))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("""with e as (select *, (props->>'$.k')::bigint as k from events) select event_id, case when k % 2 = 0 then k else 0 end as like_count, 0 as repost_count, coalesce(case when k % 3 = 0 then event_type end, 'unknown') as match_reason from e""")
def added_columns(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 2 == 0, F.col("k")).alias("like_count"), F.when(F.col("k") % 3 == 0, F.col("event_type")).alias("match_reason"))
    return ix.with_columns_of(e, {"like_count": F.lit(0), "repost_count": F.lit(0), "match_reason": F.lit("unknown")})


@query("""select split, signal, count(*) as n from (select case when doc_id % 5 = 0 then 'holdout' else 'dev' end as split, case when doc_id % 3 = 0 then 'author' else 'text' end as signal from labels) group by all""")
def case_file_strata(spark, sf_dir):
    """Evaluation cases written as a file, read back and counted by stratum."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(k.cast("string").alias("id"), F.when(k % 5 == 0, "holdout").otherwise("dev").alias("split"), F.when(k % 3 == 0, "author").otherwise("text").alias("signal"))
    path = f"{scratch(spark)}/cases"
    files.write_cases(rows, path)
    return files.read_cases(spark, path).groupBy("split", "signal").agg(F.count("*").alias("n"))


@query("""select l.doc_id, (-0.5 + 0.5 * least(l.doc_id % 5, 3) + 0.25 * (l.doc_id % 5 > 0)::int)::double as score, l.doc_id % 2 = 0 and l.doc_id % 4 = 0 as prior from labels l""")
def model_file_scores(spark, sf_dir):
    from townwire.packs import HERE

    model = LinearModel.load(HERE / "prose_full_model.json")
    n = F.col("doc_id") % 5
    f = {"micro_count": F.least(n, F.lit(3)).cast("double"), "has_micro": (n > 0).cast("double"), "unheard_of": F.lit(9.0)}
    author = F.when(F.col("doc_id") % 2 == 0, F.lit("a"))
    return table(spark, sf_dir, "labels").select("doc_id", model.score(f).alias("score"), evaluate.effective_prior(F.col("doc_id") % 4 == 0, author).alias("prior"))
