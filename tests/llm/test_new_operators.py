"""Conversation repair, lexical search and web archives against brute force and round trips."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents
from townwire.llm import conversations as conv
from townwire.llm import lexical, warc


def spoken(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, hash string, place int")


def by_force(rows):
    """Every conversation's least cost and audit by trying all edits of every turn, without a state's costs."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        conv_, turn = (" " if v is None else str(v) for v in (c, t))
        fault, role, text = zlib.crc32(f"{conv_}:{turn}".encode()) % 20, " " if r is None else r, " " if x is None else x
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        own[c] += [(t, "user" if fault == 4 else role, text)] * (fault != 0) * (2 if fault == 3 else 1)
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(own[c], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        # breadth first over (initials so far must stay a prefix of a legal conversation): all audits by cost
        best, front = None, {("", ()): 0}
        legal = lambda s: re.fullmatch("(s?(ua)*u?)?", s)
        for i in range(len(turns) + 1):
            grown = {}

            def put(key, cost, into):
                if legal("".join(r[:1] or "-" for r, _ in key[1])) and cost < into.get(key, 99):
                    into[key] = cost

            for (audit, kept), cost in front.items():
                for n in range(3):
                    for extra in itertools.product(("user", "assistant"), repeat=n):
                        put((audit + "I" * n, kept + tuple((e, "") for e in extra)), cost + 2 * n, grown)
            if i == len(turns):
                done = [(cost, audit, kept) for (audit, kept), cost in grown.items() if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept))]
                best = min(done)
                break
            _, role, text = turns[i]
            front = {}
            for (audit, kept), cost in grown.items():
                put((audit + "D", kept), cost + 3, front)
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    put((audit + "K", kept + ((role, text),)), cost + more, front)
                    for new in ("user", "assistant"):
                        put((audit + "R", kept + ((new, text),)), cost + 2 + more, front)
            least = min(front.values())
            front = {k: v for k, v in front.items() if v <= least + 8}
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        n = Counter(faults)
        whole = "\n".join(f"{r}:{x}" for r, x in best[2])
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, best[0], best[1], hashlib.sha256(whole.encode()).hexdigest())
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["Yes.", "No", "  ", "", None, "Öh! \n", "Well?", "Yes."])))
    return rows + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("gather", [conv.GATHER, 1])
def test_repair(spark, monkeypatch, gather):
    rows = conversations(7, 60)
    monkeypatch.setattr(conv, "GATHER", gather)  # 1: every conversation goes the way of pieces
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conv.repair_digests(conv.damaged(spoken(spark, rows))).collect()}
    want = by_force(rows)
    assert {c: (got[c], want[c]) for c in want if got.get(c) != want[c]} == {} and len(got) == len(want)


def test_repair_of_a_conversation_in_many_segments(spark):
    rng = random.Random(5)
    # copies in distant segments, long runs of one symbol, and conversations beside it
    rows = [(1, t, rng.choice(["user", "assistant"]) if t % 700 > 300 else "user", f"{t % 1900} ok." if t % 3 else "cut") for t in range(4_000)] + [(0, 0, "user", "a."), (2, 0, "user", "b."), (2, 1, "assistant", "c.")]
    frame = conv.undamaged(spoken(spark, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = conv.segments(frame)
        assert parts.filter("conv = '1'").select("segment").distinct().count() > 1
        got = {r["conv_id"]: r for r in conv.repair_digests(frame).collect()}
        turns = [r for r in conv.repaired_turns(frame).filter("conv_id = 1").orderBy("place").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own, seen = [], set()
    for _, t, role, text in rows[:4_000]:
        own.append((t, role[:1], conv.DUPLICATE if (role, text) in seen else conv.NONE if text[-1] == "." else conv.TRUNCATE))
        seen.add((role, text))
    whole = conv.finished("1", own)
    assert {k: got[1][k] for k in COLUMNS[:-1]} == {k: whole[k] for k in COLUMNS[:-1]}
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns)) and "".join(r["edit"] for r in turns) == whole["audit"].replace("D", "")
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest()
    assert got[2]["audit"] == "KK" and got[0]["audit"] == "D"[:0] + conv.finished("0", [(0, "u", conv.NONE)])["audit"]


def test_powers_are_the_plain_product():
    for symbol in [(r, f) for r in ("s", "u", "a", "") for f in (conv.NONE, conv.TRUNCATE)] + [("", conv.BLANK)]:
        plain = conv.transition([])
        for n in range(1, 20):
            plain = conv.times(plain, conv.power(symbol, 0))
            assert conv.transition([(symbol, n)]) == plain


def test_repair_of_nothing(spark):
    assert conv.repair_digests(conv.damaged(spoken(spark, []))).count() == 0
    dropped = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    one = conv.repair_digests(conv.damaged(spoken(spark, [(*dropped, "user", "x.")]))).collect()
    assert [tuple(r[c] for c in ("conv_id", *COLUMNS)) for r in one] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def ranked_by_force(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out.update((item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1))
    return out


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, n long, term string")


@pytest.mark.parametrize(("bucket", "numbers"), [(lexical.BUCKET, lexical.NUMBERS), (7, 1)])
def test_lexical_search(spark, monkeypatch, bucket, numbers):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "NUMBERS", numbers)
    docs = [(i, t) for i, t in awkward(11, 90)] + [(None, "abc Éé abc"), (5000, "abc ab a"), (5001, "abc ab a"), (5002, "\x7f- !")]
    items = [(1, "abc ab, a"), (1, "abc ab, a"), (2, None), (3, ""), (4, "nowhere"), (None, "É é b 1"), (5, docs[3][1]), (6, docs[-1][1]), (7, awkward(11, 90)[-5][1])]
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(documents(spark, docs), benchmark(spark, items)).collect())
    assert got == ranked_by_force(docs, items, 10)


def test_lexical_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 20)
    docs, items = awkward(12, 30), [(i, t[:15]) for i, t in awkward(12, 6)[:6]]
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(documents(spark, docs), benchmark(spark, items), 3).collect())
    assert got == ranked_by_force(docs, items, 3)


def test_lexical_search_of_nothing(spark):
    assert lexical.search(documents(spark, []), benchmark(spark, [(1, "a")])).count() == 0
    assert lexical.search(documents(spark, [(1, "a")]), benchmark(spark, [])).count() == 0
    assert lexical.search(documents(spark, [(1, None)]), benchmark(spark, [(1, "a")])).count() == 0


def test_buckets_prune_and_keep_the_best():
    rng = random.Random(2)
    rows = [{"doc_id": i, "at": sorted(rng.sample(range(30), rng.randint(1, 8))), "norm": 0.0} for i in range(500)]
    for r in rows:
        r["x"] = [rng.randint(1, 10 ** rng.randint(1, 6)) for _ in r["at"]]
        r["norm"] = math.sqrt(sum(v * v for v in r["x"]))
    b = lexical.Bucket(pa.Table.from_pylist(rows))
    for _ in range(50):
        own = [(c, rng.randint(1, 9000)) for c in rng.sample(range(40), 9)]
        weights = dict(own)
        scores = sorted(((-sum(weights.get(c, 0) * v for c, v in zip(r["at"], r["x"])), r["doc_id"]) for r in rows))
        want = [(d, -s) for s, d in scores[:10] if s]
        for least in (0, want[-1][1], want[3][1]):
            found, got = b.best(own, least, 10)
            assert [(int(b.ids[f]), s) for f, s in zip(found, got)] == [w for w in want if w[1] >= least]
        assert b.best(own, 10**18, 10) == ([], [])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, row string, kind string")


ODD = [(1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>one</p>"), (None, None, "Ünï\r\n\r\nWARC/1.1"), (7, "u", "twice"), (7, "u", "twice"), (8, "v", "x" * 300_000), (9, "w", "x" * 300_000)]


def kept(rows, least):
    """(page_id, bytes, digest, type, refers_to) by grouping whole payloads."""
    groups, out = defaultdict(list), Counter()
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        small = len(payload) < least
        for n, i in enumerate(ids):
            revisit = not small and n < len(ids) - 1
            out[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", ids[-1] if revisit else None)] += 1
    return out


@pytest.mark.parametrize("least", [0, 7])
def test_archives(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    rows = ODD + [(100 + i, f"http://h/{i}", f"<html><body><div class='menu'>Home About Contact</div><p>Page {i % 40}</p></body></html>") for i in range(120)]
    manifest = warc.write_archives(pages(spark, rows), warc.archive_folder(spark), least)
    read = warc.read_archives(manifest).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    assert got == kept(rows, least)
    assert Counter(r["html"] for r in read if r["record_type"] == "response") <= Counter(h or "" for _, _, h in rows)
    assert {r["html"] for r in read} - {None} == {h or "" for _, _, h in rows}
    assert sum(r["records"] for r in manifest.collect()) == len(rows)
    # each record is a frame of its own behind one skippable frame with the dictionary
    for r in manifest.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        magic, length = warc.FRAME_HEADER.unpack_from(data)
        assert magic == warc.DICTIONARY_FRAME and data[8:12] == b"\x37\xa4\x30\xec"
        assert data[8 + length :].count(b"\x28\xb5\x2f\xfd") >= r["records"] and len(data) == r["bytes"]


def test_archives_of_nothing(spark):
    manifest = warc.write_archives(pages(spark, []), warc.archive_folder(spark))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
    few = warc.write_archives(pages(spark, ODD[:1]), warc.archive_folder(spark))
    assert [(r["page_id"], r["html"], r["url"]) for r in warc.read_archives(few).collect()] == [(1, "<p>one</p>", "http://a/%20b%0D%0AX:%20y")]


def test_damage_is_noticed(spark):
    import io

    manifest = warc.write_archives(pages(spark, ODD[:2]), warc.archive_folder(spark))
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    with pytest.raises(ValueError, match="within a record"):
        list(warc.frames(io.BytesIO(data[:-9])))
    one = next(iter(warc.frames(io.BytesIO(data))))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(one.replace(b"<p>", b"<q>") if b"<p>" in one else one[:-5])


def test_dictionary_makes_records_smaller(spark):
    rows = [(i, f"http://h/{i}", f"<html><head><title>{i}</title></head><body><nav>Home About Contact Imprint</nav><article>{i * 7919}</article></body></html>") for i in range(300)]
    frame = pages(spark, rows).withColumn("row", F.col("page_id"))
    words = warc.dictionary(frame.select("page_id", "row", "url", "html"))
    plain, shared = warc.Archive(None), warc.Archive(words)
    for i, u, h in rows:
        for a in (plain, shared):
            a.add(warc.record(i, i, u, h.encode(), None))
    assert shared.out.tell() - len(shared.head) < 0.6 * plain.out.tell()
