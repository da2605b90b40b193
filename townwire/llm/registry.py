"""One query per corpus operator over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townwire.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.fingerprints import fingerprint_pairs

    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.conversations import damaged, repair_digests

    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from townwire.llm.warc import archive_folder, read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _repair_sql() -> str:
    """The cheapest edits turn by turn: per state after a turn the least (cost, audit)."""
    edit = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}"  # noqa: E731
    ins = lambda x: edit(x, 2, "I")  # noqa: E731
    twice = lambda x: f"{{'c': {x}.c + 4, 'a': {x}.a || 'II'}}"  # noqa: E731
    inserted = lambda: f"s0 as i0, s1 as i1, least(s2, {ins('s0')}, {ins('s1')}, {ins('s3')}) as i2, least(s3, {ins('s2')}, {twice('s0')}, {twice('s1')}) as i3"  # noqa: E731
    may = lambda x, cond: f"case when {cond} then {x} else {{'c': 1000000000, 'a': ''}} end"  # noqa: E731
    kept = lambda x, role: may(edit(x, "t", "K"), f"not gone and initial = '{role}'")  # noqa: E731
    given = lambda x: may(edit(x, "2 + t", "R"), "not gone")  # noqa: E731
    gone = lambda x: edit(x, 3, "D")  # noqa: E731
    return rf"""
        with recursive coded as (
          select *, coalesce(conv_id::varchar, ' ') as conv, coalesce(role, ' ') as r, coalesce(text, ' ') as x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as code from conversations),
        faulty as (
          select *, xor(list_reduce(list_transform(string_split(code, ''), lambda c: ascii(c)::bigint), lambda a, b: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(a, b)), 4294967295::bigint), 4294967295::bigint) % 20 as f from coded),
        damaged as (
          select conv, turn, case when f = 4 then 'user' else r end as role, case f when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end as text, unnest(range(case when f = 3 then 2 else 1 end)) as copy
          from faulty where f <> 0),
        placed as (select *, row_number() over (partition by conv order by turn nulls first, sha256(strlen(role) || ':' || role || text), copy) as p from damaged),
        looked as (
          select *, left(role, 1) as initial, not regexp_matches(text, '[^ 	-]') as blank, row_number() over (partition by conv, role, text order by p) > 1 as again,
            not regexp_matches(text, '[.!?][ 	-]*$') as cut, lag(left(role, 1)) over (partition by conv order by p) as before from placed),
        turns as (select *, blank or again as gone, (cut and not blank and not again)::int as t from looked),
        facts as (
          select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
            sum(t)::bigint as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(p) as n from turns group by conv),
        steps as (
          select conv, 0::bigint as p, {{'c': 0, 'a': ''}} as s0, {{'c': 1000000000, 'a': ''}} as s1, {{'c': 1000000000, 'a': ''}} as s2, {{'c': 1000000000, 'a': ''}} as s3 from facts
          union all
          select conv, p, {gone('i0')}, least({gone('i1')}, {kept('i0', 's')}), least({gone('i2')}, {given('i0')}, {given('i1')}, {given('i3')}, {kept('i0', 'u')}, {kept('i1', 'u')}, {kept('i3', 'u')}), least({gone('i3')}, {given('i2')}, {kept('i2', 'a')})
          from (select t.conv, t.p, t.gone, t.t, t.initial, {inserted()} from steps s join turns t on t.conv = s.conv and t.p = s.p + 1)),
        ended as (select conv, least(i0, i3) as best from (select s.conv, {inserted()} from steps s join facts f on f.conv = s.conv and f.n = s.p)),
        letters as (select conv, unnest(string_split(best.a, '')) as l, generate_subscripts(string_split(best.a, ''), 1) as i from ended where best.a <> ''),
        counted as (select *, count(*) filter (where l <> 'I') over w as p, count(*) filter (where l <> 'D') over w as stays from letters window w as (partition by conv order by i)),
        joined as (
          select c.conv, c.i, c.l, c.stays, t.role, t.text, max(case when c.stays = 1 and c.l = 'K' and t.initial = 's' then 1 else 0 end) over (partition by c.conv) as lead
          from counted c left join turns t on c.l <> 'I' and t.conv = c.conv and t.p = c.p),
        repaired as (
          select conv, string_agg(case when l = 'K' then role when (stays - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i) as whole
          from joined where l <> 'D' group by conv)
        select o.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank, coalesce(f.duplicate, 0)::bigint as duplicate, coalesce(f.truncated, 0)::bigint as truncated, coalesce(f.illegal, 0)::bigint as illegal,
          coalesce(e.best.c, 0)::bigint as cost, coalesce(e.best.a, '') as audit, sha256(coalesce(r.whole, '')) as repaired_sha256
        from (select distinct conv_id, conv from coded) o left join facts f using (conv) left join ended e using (conv) left join repaired r using (conv)
    """


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_html_text, op3_sentencepiece, op4_token_counts, op5_fingerprints, op6_toxicity, op7_best_fit_packing, op8_exact_top_k, op9_substring_dedup, op10_simhash_near_dedup, op11_conversation_repair, op12_lexical_search, op13_warc)}
ORACLES = {
    "op1_line_dedup": r"""
        with lines as (
          select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
        keyed as (select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
        repeated as (select key, max(doc_id) as kept from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        marked as (select k.*, r.key is not null and r.kept <> k.doc_id as lost from keyed k left join repeated r using (key))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
        from marked group by doc_id
    """,
    "op8_exact_top_k": """
        with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r),
        ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from pairs)
        select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
    """,
    "op9_substring_dedup": r"""
        with w as (
          select doc_id, unnest(l) as word, generate_subscripts(l, 1) as pos
          from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents)),
        windows as (
          select doc_id, pos, md5(string_agg(word, ' ') over s) as h, count(*) over s as n from w
          window s as (partition by doc_id order by pos rows between current row and 34 following)),
        twice as (select h from windows where n = 35 group by h having count(*) > 1),
        hit as (select doc_id, pos, case when n = 35 and h in (select h from twice) then 1 else 0 end as hit from windows),
        covered as (select doc_id, pos, max(hit) over (partition by doc_id order by pos rows between 34 preceding and current row) as lost from hit)
        select d.doc_id, count(w.word)::bigint as n_words, count(*) filter (where c.lost = 1)::bigint as n_removed,
          sha256(coalesce(string_agg(w.word, ' ' order by w.pos) filter (where c.lost = 0), '')) as kept_sha256
        from documents d left join w on w.doc_id = d.doc_id left join covered c on c.doc_id = w.doc_id and c.pos = w.pos
        group by d.doc_id
    """,
    "op11_conversation_repair": _repair_sql(),
    "op12_lexical_search": r"""
        with d as (
          select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as l from documents),
        total as (select count(*) as docs, sum(len(l))::bigint as terms from d where len(l) > 0),
        tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(l) as n, unnest(l) as term from d) group by r, doc_id, n, term),
        weight as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), total),
        q as (
          select row_number() over () as q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as l from benchmark),
        asked as (select q, item_id, unnest(l) as term from q),
        scored as (
          select q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score
          from asked join weight using (term) join tf using (term), total group by q, item_id, r, doc_id),
        ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
    """,
    "op13_warc": """
        with p as (select row_number() over () as r, page_id, coalesce(html, '') as payload from pages),
        placed as (select *, row_number() over (partition by payload order by page_id desc nulls last, r) as k, max(page_id) over (partition by payload) as largest from p),
        hashed as (select *, sha1(payload) as hex from placed),
        parts as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i::int + 1, 5))::bigint) as five from hashed)
        select page_id, strlen(payload)::bigint as payload_bytes,
          list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), 'string_agg', '') as payload_digest,
          case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then largest end as refers_to
        from parts
    """,
}
