"""Top-k, HTML text, fingerprints and toxicity against brute force, fixtures and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.clauses import CLAUSES, INSULTS
from tests.llm.helpers import awkward, documents
from townwire.llm import fingerprints, html_text, top_k, toxicity


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, v string, score string")


def top_by_force(rows, every, k, scale):
    ints = [(i, [math.floor(Fraction(float(np.float32(x))) * scale) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    long = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = Counter()
    for n, (i, q) in enumerate(ints):
        if i % every == 0:
            best = sorted((-dot(q, v), c) for m, (c, v) in enumerate(ints) if m != n)[:k]
            out.update((i, r, c, long(-s)) for r, (s, c) in enumerate(best, 1))
    return out


@pytest.mark.parametrize("dims", [3, 40])
def test_top_k(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(8, dims))
    rows = [(i, (base[i % 8] + (i % 3) * 0.01).tolist()) for i in range(150)]  # many equal vectors
    rows += [(200, None), (201, [None] * dims), (202, [math.nan] * dims), (203, [math.inf] * dims), (204, [1.0]), (205, []), (None, base[0].tolist()), (206, base[0].tolist()), (206, base[0].tolist()), (210, base[1].tolist())]
    rows += [(206, base[2].tolist()), (20, base[0].tolist()), (20, base[3].tolist())]  # rows that share an id are rows of their own
    got = Counter(tuple(r) for r in top_k.top_k(vectors(spark, rows), every=10, k=5).collect())
    assert got == top_by_force(rows, 10, 5, 256)


def test_top_k_keeps_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0])]
    assert sorted(tuple(r) for r in top_k.top_k(vectors(spark, rows)).collect()) == [(0, 1, 1, 58880), (0, 2, 1, 32768)]


def test_top_k_of_wide_numbers_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-3, 38)).tolist()) for i in range(60)]
    rows += [(100, [3e38] * 6), (101, [3e38] * 6), (102, [-3e38] * 6), (103, [2.0**27, 2.0**27]), (104, [2.0**27, 2.0**27])]
    got = Counter(tuple(r) for r in top_k.top_k(vectors(spark, rows), every=10, k=7).collect())
    assert got == top_by_force(rows, 10, 7, 256)
    assert any(abs(r[3]) >= 2**63 - 1 for r in got)


def test_top_k_of_few(spark):
    assert top_k.top_k(vectors(spark, [])).count() == 0
    assert {tuple(r) for r in top_k.top_k(vectors(spark, [(0, [1.0]), (1, [2.0])])).collect()} == {(0, 1, 1, 256 * 512)}


def test_search_block_never_prunes_ties():
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (48, 400))
    q = rng.integers(-3, 4, (48, 6))
    ids = np.arange(400)
    for query, found, scores in top_k.search_block(np.arange(6), q.astype(float), np.full(6, -np.inf), ids, ids, v.astype(float), 7):
        full = q[:, query] @ v
        order = [i for i in np.lexsort((ids, -full)) if i != query][:7]
        assert found.tolist() == order and scores.tolist() == full[order].tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<header class="site"><h1>Site {i}</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">More</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><h1>Title &amp; {i}</h1><p>First  <b>bold</b>&nbsp;text<br>line {i}<p>Second &lt;{i}&gt;<ul><li>one {i}<li>two {i}</ul>
<form><p>Mail <input></p></form><aside>Side {i}</aside><div class="ad-slot">Buy {i}</div><p>Read more on our site</p><section id="comments"><p>Reader {i}</p></section></article></main>
<div id="sidebar2"><p>Links</p></div><footer>&copy; {i}</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string")


def test_html_text(spark):
    rows = [(i, f"https://user@Host.example:8080/{i}", PAGE.format(i=i)) for i in range(12)]
    plain = "<body><div>Menu <a href=x>all of it linked</a></div><p>Some text</p><p>cut <"
    rows += [(100, None, None), (101, "u", ""), (102, "http://other.example/", plain + "b"), (103, "http://other.example/", "no tags &amp; all"), (104, "x", "<article>open <p>end"), (104, "x", "<article>open <p>end"), (105, "y", "a < b <p>c"), (106, "z", "<p " + "x" * 5000)]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(pages(spark, rows)).collect()}
    want = {i: f"Title & {i}\n\nFirst bold text line {i}\n\nSecond <{i}>\n\none {i}\n\ntwo {i}" for i in range(12)}
    want |= {100: "", 101: "", 103: "no tags & all", 104: "open\n\nend", 105: "a < b\n\nc", 106: ""}
    want[102] = "Some text\n\ncut"
    assert got == {(i, t, len(t)) for i, t in want.items()}
    assert html_text.main_text(pages(spark, [])).count() == 0


#: Bodies of an article, and the text that they hold.
BROKEN = [
    ("<p class=it's>long text {i}</p><p>Second", "long text {i}|Second"), ('<p title="x"" >one {i}</p><p>two', "one {i}|two"), ('<p title=5" >one {i}<p>two', "one {i}|two"), ("<p data-x='a' b=\"c>d\" '>one {i}<p>two", "one {i}|two"),
    ('<p>if a <b "quoted and c" {i} in running text</p><p>next', 'if a <b "quoted and c" {i} in running text|next'), ("<p>1 < 2 and {i}</p><p>3 > 2", "1 < 2 and {i}|3 > 2"),
    ('<header class="header"><h1>Title {i}</h1></header><h2 class="share-title">Share {i}</h2><h2 class="related-header">Related work {i}</h2><h3 id="comments">On comments {i}</h3><p>a', "Title {i}|Share {i}|Related work {i}|On comments {i}|a"),
    ('<section id="search-methods"><p>Methods {i}</section><div class="social-history">History {i}</div><p>x <math>y{i}</math> z</p><object>fallback {i}</object>', "Methods {i}|History {i}|x y{i} z|fallback {i}"),
    ('<p>a {i}<div class="ad-slot">Buy</div><section id="comments"><p>Reader</p></section><nav>Menu</nav><aside>Side</aside><form><p>Mail</form><footer>Foot</footer>', "a {i}"),
]


@pytest.mark.parametrize("pages_a_host", [5, 12])
def test_articles_on_hosts_of_any_size(spark, pages_a_host):
    """Broken markup loses nothing, an article's own headings stay, and text beside the article stays out, whatever the host's size."""
    long, side = " ".join(f"word{k}" for k in range(60)), " ".join(f"side{k}" for k in range(40))
    page = "<html><body><header><p>Site</p></header><nav><a href=/>Home</a></nav><article>{body}<p>" + long + " {i}</p></article><div>" + side + " {i}</div><footer>Foot</footer></body></html>"
    rows, want = [], {}
    for k, (body, text) in enumerate(BROKEN):
        for i in range(pages_a_host):
            rows.append((100 * k + i, f"http://h{k}.example/{i}", page.replace("{body}", body).replace("{i}", f"n{i}")))
            tail = f"{long} n{i}"
            want[100 * k + i] = "\n\n".join([*text.replace("{i}", f"n{i}").split("|"), tail])
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert {p: (got[p], want[p]) for p in want if got[p] != want[p]} == {}


def test_a_page_cut_off_within_a_tag():
    read = lambda html: [b[2] for b in html_text.blocks(html)]
    assert read("<p>a<p foo") == ["a"] and read("<p>a <") == ["a <"] and read("<p>a</") == ["a"] and read('<p>a<p title="b>c') == ["a", "c"]


def template_of(spark, rows):
    return {r["host"]: r for r in html_text.templates(html_text.parsed(pages(spark, rows))).collect()}


def test_template_finds_fixed_text(spark):
    rows = [(i, "http://h.example/", PAGE.format(i=i)) for i in range(12)]
    t = template_of(spark, rows)
    assert list(t) == ["h.example"] and t["h.example"]["fixed"] and t["h.example"]["valid"]
    assert template_of(spark, rows[:5]) == {}


def classes_by_force(rows):
    """Equivalence classes of one host's pages from whole occurrence vectors: {tokens in order: pages}."""
    import xxhash

    digest = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
    streams = []
    for h in dict.fromkeys(h for _, _, h in rows):
        streams.append([digest(x) for path, _, text, *_ in html_text.blocks(h) for x in (path, f"{path}\n{text}")])
    vectors = {}
    for t in set().union(*streams):
        vectors.setdefault(tuple(s.count(t) for s in streams), set()).add(t)
    found = {}
    for vector, tokens in vectors.items():
        n = sum(v > 0 for v in vector)
        if n >= 0.5 * len(streams) and len(tokens) >= 2:
            orders = [[t for t in s if t in tokens] for s in streams]
            first = next(o for o in orders if o)[: len(tokens)]
            if all(o == first * (len(o) // len(tokens)) for o in orders):
                found[tuple(first)] = n
    wider = sorted(found, key=lambda c: (-found[c], -min(c)))
    out = {}
    for k, c in enumerate(wider):
        ok = True
        for s in streams:
            at = [i for i, t in enumerate(s) if t in c]
            for a in range(0, len(at), len(c)):
                between = s[at[a] : at[a + len(c) - 1]] if at else []
                ok = ok and not any(t in w for w in wider[:k] for t in between)
        if ok:
            out[c] = found[c]
    return out


#: No telling names anywhere: menus, a long notice that all pages hold, records of varying number, an article, teasers.
PLAIN = """<body><div><p>{menu}</p></div><div><p>By reading on you agree to all of what the long and tiresome rules of this very site say about you and about us.</p></div>
<div><h2>{t}</h2><p>{a}</p><p>{b}</p>{more}</div><div><p>Latest</p>{teasers}</div><div><p>Contact</p></div>"""


def plain_pages(n=14):
    rng = random.Random(6)
    word = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        own = [f"Title {i}", word(20), word(14), *(word(13) for _ in range(i % 3))]
        menu = " ".join(f"<a href=/{word(1)}>{word(1)}</a>" for _ in range(4))
        teasers = "".join(f"<p><a href=/x>{word(3)}</a></p><p>{i}.{k}.</p>" for k in range(i % 4))
        rows.append((i, f"http://p.example/{i}", PLAIN.format(menu=menu, t=own[0], a=own[1], b=own[2], more="".join(f"<p>{p}</p>" for p in own[3:]), teasers=teasers)))
        want[i] = own
    return rows, want


def test_classes_match_brute_force(spark):
    for rows in (plain_pages()[0], [(i, "http://p.example/", PAGE.format(i=i)) for i in range(12)]):
        (t,) = template_of(spark, rows).values()
        assert {tuple(c["tokens"]): c["pages"] for c in t["valid"]} == classes_by_force(rows) != {}


def test_template_decides_without_names(spark, monkeypatch):
    """Menus, notices and endings in plain elements go by the template alone; without it they stay."""
    for names in ("NOT_CONTENT", "NOT_CONTENT_WORDS", "NOT_CONTENT_ROLES", "CONTENT"):
        monkeypatch.setattr(html_text, names, frozenset())
    import xxhash

    digest = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)
    rows, want = plain_pages()
    row = next(iter(template_of(spark, rows).values()))
    template = {k: set(row[k]) for k in ("tokens", "menus", "running", "fixed")} | {"main": row["main"]}
    assert row["main"] == "/body/div"
    for i, _, h in rows:
        found = list(html_text.blocks(h))
        place, words = [digest(b[0]) for b in found], [digest(f"{b[0]}\n{b[2]}") for b in found]
        texts = lambda t: [found[k][2] for k in html_text.content(found, place, words, t)]  # noqa: B023, E731
        assert texts(template) == want[i]
        assert "Contact" in texts(None) and any(x.startswith("By reading on") for x in texts(None))


def main_texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}


def test_article_keeps_its_fixed_text(spark):
    listed = PAGE.replace("<li>one {i}<li>two {i}", "<li>one<li>two")
    got = main_texts(spark, [(i, f"http://a.example/{i}", listed.format(i=i)) for i in range(12)])
    assert got == {i: f"Title & {i}\n\nFirst bold text line {i}\n\nSecond <{i}>\n\none\n\ntwo" for i in range(12)}
    headed = "<article><h1>Day {i}</h1><div class=ad>Buy</div><h2>Summary</h2><p>Text {i}</p><h2>References</h2><p>Book {i}</p></article>"
    got = main_texts(spark, [(i, f"http://b.example/{i}", headed.format(i=i)) for i in range(12)])
    assert got == {i: f"Day {i}\n\nSummary\n\nText {i}\n\nReferences\n\nBook {i}" for i in range(12)}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_copies_of_one_article_keep_it(spark, tag):
    page = "<body><nav>Menu</nav><{tag}><h1>{t}</h1><p>Short one<p>And two<ul><li>a<li>b</ul></{tag}><footer>Foot</footer></body>"
    want = "{t}\n\nShort one\n\nAnd two\n\na\n\nb"
    copies = [(i, f"http://c.example/{i}", page.format(tag=tag, t="Same")) for i in range(12)]
    assert main_texts(spark, copies) == {i: want.format(t="Same") for i in range(12)}
    others = [(1000 + i, f"http://c.example/o{i}", f"<body><nav>Menu</nav><{tag}><h1>Other {i}</h1><p>Own {i}</{tag}></body>") for i in range(12)]
    many = [(i, f"http://c.example/{i}", page.format(tag=tag, t="Same")) for i in range(200)]
    assert main_texts(spark, many + others) == {i: want.format(t="Same") for i in range(200)} | {1000 + i: f"Other {i}\n\nOwn {i}" for i in range(12)}


LONG = "Thirteen words or more make running text, so this sentence has quite enough of them."


@pytest.mark.parametrize(("page", "want"), [
    ('<div style="overflow:hidden"><p>Text</div>', ["Text"]), ('<div aria-hidden="false" data-id="menu"><p>Text</div>', ["Text"]), ('<p>Text<div hidden>No</div><div HIDDEN="">No</div>', ["Text"]),
    ('<div title="hidden class=ad role=menu"><p>Text</div>', ["Text"]), ("<p>Text<div class='x ad'>No</div><div id=menu>No</div>", ["Text"]),
    ('<div class="content with-sidebar"><p>Text<div class="sidebar">No</div></div>', ["Text"]),
    (f'<div id="discussion-page"><article><p>{LONG}<div class="comments"><article><p>No</article></div></article><div class="related"><article><p>No</article></div></div>', [LONG]),
    (f'<main><h1>Title</h1><div class="search-page"><article><p>{LONG}</article></div></main>', ["Title", LONG]),
    (f'<article><p>{LONG}</article><div class="related"><article><p>{LONG} No</article></div>', [LONG]),
    (f'<div><p>{LONG}</div><div class="related"><article><p>No</article></div>', [LONG]),
    (f'<article><p>Text</article><nav><article><p>{LONG}</article></nav>', ["Text"]),
])
def test_attributes_and_marked_wrappers(page, want):
    found = list(html_text.blocks(f"<html><body>{page}</body></html>"))
    assert [found[i][2] for i in html_text.own_blocks(found)] == want


def test_repeated_rows_change_no_text(spark):
    page = "<body><div><h2>{t}</h2><p>Text {i}<p>All of these pages say so</div></body>"
    rows = [(i, f"http://d.example/{i}", page.format(i=i, t="Often" if i % 4 else f"Seldom {i}")) for i in range(20)]
    few = [(100 + i, f"http://e.example/{i}", page.format(i=i, t="Few")) for i in range(6)]
    got = main_texts(spark, rows + few)
    assert got[1] == "Often\n\nText 1" and got[101] == "Few\n\nText 1\n\nAll of these pages say so"
    assert main_texts(spark, 2 * (rows + few)) == got


def test_fingerprints(spark):
    rows = awkward(11, 30)
    out = fingerprints.fingerprint_pairs(documents(spark, rows)).collect()
    order = sorted(((math.inf if d is None else d, t or "") for d, t in rows))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = sorted((math.inf if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out)
    assert got == sorted(want)
    by_text = {}
    of = {(r["doc_id"], r["n_chars"]): r for r in out}
    for d, t in rows:
        assert by_text.setdefault(t or "", of[d, len(t or "")]["fingerprint"]) == of[d, len(t or "")]["fingerprint"]
    assert by_text[""] == "" and len(set(by_text.values())) > 25
    long = of[1005, max(n for d, n in of if d == 1005)]
    assert 0.15 < long["near_edited"] < 0.75 and long["near_next"] == 0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    single = fingerprints.fingerprint_pairs(documents(spark, [(5, "only one text here")])).first()
    assert single["near_next"] == 1.0 and fingerprints.fingerprint_pairs(documents(spark, [])).count() == 0


def test_no_text_of_any_length_is_without_anchor(spark):
    rng = random.Random(8)
    rows = [(n, " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(n))) for n in range(1, 11) for _ in range(30)]
    got = spark.createDataFrame(rows, "n int, t string").select("n", "t", fingerprints.anchors(F.col("t")).alias("a")).collect()
    assert all(r["a"] for r in got) and len({(r["t"], tuple(x >> 24 for x in r["a"])) for r in got}) == len({tuple(x >> 24 for x in r["a"]) for r in got})
    assert spark.createDataFrame([("",)], "t string").select(fingerprints.anchors(F.col("t"))).first()[0] == []


def test_likeness_matches_places(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefghijkl", k=rng.randint(1, 7))) for _ in range(n)]
    shared = words(300)
    rows = [(1, " ".join(words(9000) + shared + words(100))), (2, " ".join(words(2000) + shared + words(7000))), (3, " ".join(words(9000)))]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(documents(spark, rows)).collect()}
    assert 0.005 < got[1]["near_next"] < 0.03 and got[2]["near_next"] == 0 and got[3]["near_next"] == 0
    assert 0.25 < got[1]["near_edited"] < 0.45 and len(got[1]["fingerprint"]) > 6 * 64 * 14
    at = lambda *places: [(h + 1 << 24) + p for h, p in enumerate(places)]
    cases = [(at(0, 1, 2, 3), at(5, 6, 7, 8), 1.0), (at(0, 1, 2, 3), at(0, 5, 11, 20), 0.0), (at(0, 1, 2, 3), at(4, 5, 30, 50), 0.5), (at(7), at(3), 1.0), (at(7), at(3, 4), 0.5), ([], [], 1.0), ([], at(1), 0.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(random.Random(1).randrange(10**12) + k * k, f"text {k}") for k in range(60)] + [(7, "b"), (7, "a")]
    df = documents(spark, rows, clash=False).select("doc_id", "text")
    got = {(r["text"], r["next_text"]) for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    order = [t for _, t in sorted(rows)]
    assert got == set(zip(order, order[1:] + order[:1]))


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(random.Random(2).choices(["alpha", "be", "gammas", "d"], k=120))
    got = spark.createDataFrame([(text,)], "t string").select(fingerprints.anchors(F.col("t")).alias("a"), F.xxhash64("t").alias("_")).first()["a"]
    places = {x & 0xFFFFFF for x in got}
    shifted = spark.createDataFrame([("zzz zzz " + text,)], "t string").select(fingerprints.anchors(F.col("t")).alias("a")).first()["a"]
    # the same passage two pieces later has the same anchors, two places later
    common = {x >> 24 for x in got} & {x >> 24 for x in shifted}
    assert len(common) >= 0.9 * len(got) and places
    assert {(x >> 24, (x & 0xFFFFFF) + 2) for x in got if x >> 24 in common} == {(x >> 24, x & 0xFFFFFF) for x in shifted if x >> 24 in common}


def anchors_by_force(text):
    """{hash: first place} by the definition, with the standard XXH64."""
    import regex
    import xxhash

    def chained(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    consonants = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ56789"
    pieces = regex.findall(rf"[{consonants}]+[^\s{consonants}]?|[^\s{consonants}]", text)
    low = lambda h: h & 0xFFFFFFFF
    inner = [chained(a, b) for a, b in zip(pieces, pieces[1:])]
    found = {}
    for i in range(len(pieces) - 5):
        window = inner[i : i + 5]
        if min(window) in (window[0], window[4]):
            found.setdefault(low(chained(window[0], window[2], window[4])), i)
    return found or ({low(chained(" ".join(pieces))): 0} if pieces else {})


def likeness_by_force(a, b):
    if not a and not b:
        return 1.0
    apart = Counter(b[h] - a[h] for h in a.keys() & b.keys())
    agreed = sum(n for n in apart.values() if n > 1 or min(len(a), len(b)) == 1)
    return agreed / (len(a) + len(b) - len(a.keys() & b.keys()))


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(12)
    cjk = "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(400))
    rows = [(d, t) for d, t in awkward(11, 25) if d is not None] + [(5000, cjk), (5001, "的" + cjk[:300]), (5002, "x" * 4000), (5003, "Größe ñandú 12345 67890 été")]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(documents(spark, rows), keep=None).collect()}
    order = sorted((d, t or "") for d, t in rows)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        own, edited, following = (anchors_by_force(x) for x in (t, t[: len(t) - half] + after[:half], after))
        assert got[d]["fingerprint"] == "".join(f"{h:08x}{p:06x}" for h, p in sorted(own.items()))
        assert got[d]["edited_fingerprint"] == "".join(f"{h:08x}{p:06x}" for h, p in sorted(edited.items()))
        assert got[d]["near_edited"] == pytest.approx(likeness_by_force(own, edited)) and got[d]["near_next"] == pytest.approx(likeness_by_force(own, following))


@pytest.mark.parametrize("text", ["".join(chr(0x4E00 + (k * k * 7919 + k) % 5000) for k in range(3000)), "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=3000))])
def test_texts_without_spaces_keep_their_anchors(spark, text):
    rows = [text, "x" + text, text[:1500] + "y" + text[1500:]]
    own, ahead, inside = ({x >> 24 for x in r["a"]} for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(fingerprints.anchors(F.col("t")).alias("a")).collect())
    assert len(own & ahead) > 0.9 * len(own) and len(own & inside) > 0.9 * len(own)


def labelled(spark, n=600):
    rng = random.Random(4)
    filler = ["der", "said", "not", "you", "house", "tree", "lamp", "river", "stone", "green", "walks", "."]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = rng.choices(filler, k=rng.randint(5, 40))
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumphead", "Snorkel!", f"blargh{rng.randrange(99)}"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    labels += [(0, 1, None), (None, 1, 1), (99999, 1, 1), (3, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    table = documents(spark, [*docs, (5000, None), (5001, ""), (5002, "grumphead " * 3000), (None, "snorkel"), (1, docs[1][1])])
    out = toxicity.score_toxicity(table, labels).collect()
    assert len(out) == table.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.98 * len(held) > 50
    by = {r["doc_id"]: r["predicted"] for r in out}
    assert (by[5000], by[5001], by[5002], by[None]) == (0, 0, 1, 1)
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score_toxicity(documents(spark, [(1, "a b")]), empty).collect()] == [0]
    assert toxicity.score_toxicity(documents(spark, []), empty).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("grump", 2.0), ("a tree", 0.0), ("you grump", 3.0), ("not a grump", 0.5), ("not. grump", 2.0), ("he said grump here", 0.75), ("grump here, he said", 0.75), ("they said nothing. grump", 2.0), ("said nothing\ngrump", 2.0),
    ("kill", 0.0), ("kill time. you", 0.0), ("you kill", 4.0), ("not you kill", 1.0), ("GRUMP!", 2.0), ("grumpish", 2.0), ("grump.*** grump", 4.0),
    ("grump grump", 3.0), ("grump grump grump grump grump grump", 4.0 * (1 - 0.5**6)), ("grump. grump", 4.0), ("killed you", 0.0),
])
def test_grammar(text, want):
    assert toxicity.Scorer({"grump": 2.0, "grump ": 2.0}, 4.0).clauses(text) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [
    ("I will kill you", 4.0), ("I'll kill you tomorrow.", 4.0), ("we will hurt them", 4.0), ("matar a ellos", 4.0), ("killing them", 4.0), ("kill. you", 0.0), ("kill a b c you", 4.0), ("kill a b c d you", 0.0), ("you kill you", 4.0),
    ("kill and murder you", 6.0), ("not kill you", 1.0), ("he said kill you", 1.0), ("not kill you. kill you", 5.0), ("matarte", 4.0), ("no matarte", 1.0), ("kill them!", 4.0),
    ("grump you", 3.0), ("you grump you", 3.0), ("grump. you", 2.0), ("not grump you", 0.75), ("je vais tuer ton chien", 0.0),
])
def test_grammar_looks_both_ways(text, want):
    assert toxicity.Scorer({"grump": 2.0, "grump ": 2.0}, 4.0).clauses(text) == pytest.approx(want)


def accuracy(language, patterns):
    scorer = toxicity.Scorer(INSULTS, 8.0, patterns)
    right = [(scorer.clauses(text) >= 5) == bool(toxic) for text, toxic in CLAUSES[language]]
    return sum(right) / len(right)


@pytest.mark.parametrize("language", list(CLAUSES))
def test_every_pattern_is_needed(language):
    """In each language all patterns together read the clauses better than without any one of them."""
    whole = accuracy(language, toxicity.PATTERNS)
    assert whole >= 0.9
    for left_out in toxicity.PATTERNS:
        assert accuracy(language, tuple(p for p in toxicity.PATTERNS if p != left_out)) < whole


def test_stems_need_several_words(spark):
    """A word that toxic documents share is learned whole, so that others which begin alike stay clean; a start that many share is learned as such."""
    rng = random.Random(5)
    filler = ["house", "tree", "lamp", "river", "stone"]
    rows = [(i, " ".join([*rng.choices(filler, k=9), *(["pathetic", f"blargh{i}"] if i % 3 == 0 else [])])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon, *rest = toxicity.fit(documents(spark, rows), labels)
    assert "pathetic " in lexicon and "blargh" in lexicon and not {"path", "pathe", "pathet"} & set(lexicon)
    scorer = toxicity.Scorer(lexicon, rest[-1])
    assert scorer.clauses("pathology and a pathway") == 0 and scorer.clauses("blargh77777") > 0


def test_words_of_one_text_are_no_sum(spark):
    """The order of texts by clauses is not that by the sum of their words."""
    scorer = toxicity.Scorer({"grump ": 2.0})
    one_clause, quoted, two = "grump grump grump", "she said grump. he said grump. they said grump", "you grump. you grump"
    assert scorer.clauses(quoted) < scorer.clauses(one_clause) < scorer.clauses(two)


@pytest.mark.parametrize(("text", "want"), [
    ("he said: I will kill you", 1.0), ("I will kill you: he said hello", 4.0), ("she wrote: he was right. I will kill you", 4.0), ("Kill, and then you die", 0.0),
    ("you, grump", 3.0), ("no, you grump", 3.0), ("not you grump", 0.75), ("look: grump, look: grump", 4.0), ("my friend, he said, kill him", 1.0), ("grump : she said", 2.0), (":", 0.0), (",,:.", 0.0),
])
def test_toxicity_marks(text, want):
    """A report reaches over a colon; a comma parts a threat from its target and a negation from what follows."""
    assert toxicity.Scorer({"grump ": 2.0}, 4.0).clauses(text) == pytest.approx(want)


def read_naively(words):
    """The score of a text given as (word, mark) pairs, straight from the docstring: every pattern looked for by positions."""
    total, begin = 0.0, 0
    for end in [i for i, (_, m) in enumerate(words) if m == "."] + [len(words) - 1]:
        piece, begin = words[begin : end + 1], end + 1
        groups = {}
        for i, (w, _) in enumerate(piece):
            if w not in ("grump", "kill"):
                continue
            marks = lambda a, b: [m for _, m in piece[min(a, b) : max(a, b)]]
            nearest = lambda ws, js: next((j for j in js if 0 <= j < len(piece) and piece[j][0] in ws), None)

            def near(js, w=w, i=i, marks=marks, nearest=nearest):
                j = nearest(("you",), js)
                return j is not None and ":" not in marks(i, j) and (w == "grump" or "," not in marks(i, j))

            targeted = near(range(i - 1, i - 5, -1)) or near(range(i + 1, i + 5))
            j = nearest(("not",), range(i - 1, i - 5, -1))
            negated = j is not None and not {",", ":"} & set(marks(i, j))
            reported = any(p == "said" and (k < i or ":" not in marks(i, k)) for k, (p, _) in enumerate(piece))
            weight = (2.0 * (1.5 if targeted else 1) if w == "grump" else 4.0 * targeted) * (0.25 if negated or reported else 1)
            groups.setdefault(sum(m == ":" for _, m in piece[:i]), []).append(weight)
        total += sum(x * 0.5**k for g in groups.values() for k, x in enumerate(sorted(g, reverse=True)))
    return total


def test_toxicity_reads_clauses_as_a_naive_reader():
    rng = np.random.default_rng(8)
    scorer = toxicity.Scorer({"grump ": 2.0}, 4.0)
    for _ in range(3_000):
        words = [(str(rng.choice(["a", "b", "grump", "kill", "you", "not", "said"])), str(rng.choice(["", "", "", "", ",", ":", "."]))) for _ in range(int(rng.integers(1, 25)))]
        text = " ".join(w + m for w, m in words)
        assert scorer.clauses(text) == pytest.approx(read_naively(words)), text


def test_rows_of_one_key_are_split_among_ranges(spark, monkeypatch):
    """Null and repeated ids fill several ranges; each row's next is still the next by key and text."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices("ab é字𝄞", k=rng.randrange(1, 90))) for _ in range(120))]
    rows = [(rng.choice([1, 7, 7, 7, 2**63 - 1, 2**63 - 1, rng.randrange(50)]), rng.choice(texts)) for _ in range(400)]
    out = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", ["text"])
    order = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    want = Counter((d, t, after) for (d, t), (_, after) in zip(order, order[1:] + order[:1]))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()) == want
    ranges = out.groupBy(F.spark_partition_id(), "doc_id").count().groupBy("doc_id").count().collect()
    assert all(r["count"] > 1 for r in ranges if r["doc_id"] in (7, 2**63 - 1))


def test_likeness_is_that_of_the_fingerprints(spark):
    """What a caller computes from the returned strings is the likeness returned, with all anchors and with few."""
    rng = random.Random(21)
    base = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(400)) for _ in range(2)]
    rows = [(1, base[0]), (2, base[0][600:] + base[1]), (3, base[1]), (4, "")]
    read = lambda x: {int(x[i : i + 8], 16): int(x[i + 8 : i + 14], 16) for i in range(0, len(x), 14)}
    for keep in (None, 16):
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(documents(spark, rows), keep=keep).collect()}
        for d, after in ((1, 2), (2, 3), (3, 4)):
            assert got[d]["near_edited"] == pytest.approx(likeness_by_force(read(got[d]["fingerprint"]), read(got[d]["edited_fingerprint"])))
            assert got[d]["near_next"] == pytest.approx(likeness_by_force(read(got[d]["fingerprint"]), read(got[after]["fingerprint"])))
