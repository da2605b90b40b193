"""Line dedup, substring dedup and SimHash against brute force over awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import awkward, documents
from townwire.llm import line_dedup, simhash, substring_dedup
from townwire.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def lines_by_force(rows):
    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("seed", [3])
def test_line_dedup(spark, seed):
    rows = awkward(seed)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    assert got == lines_by_force(rows)
    assert sum(x[2] for x in got) > 5


def test_line_dedup_holds_with_full_filters(spark):
    rows = awkward(3)
    lost = {r["doc_id"]: len(r["keys"]) for r in line_dedup.lost_keys(documents(spark, rows), 20, 3, bits=64 * 64).collect()}
    assert lost == {r["doc_id"]: len(r["keys"]) for r in line_dedup.lost_keys(documents(spark, rows), 20, 3).collect()} and lost


def test_rewrite_lines_keeps_columns(spark):
    docs = documents(spark, awkward(3))
    out = line_dedup.rewrite_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out.collect())


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def windows_by_force(rows, width):
    n = Counter(tuple(words(t)[i : i + width]) for _, t in rows for i in range(len(words(t)) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        lost = {k for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((d, len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost)))
    return Counter(out)


@pytest.mark.parametrize(("width", "cap"), [(35, 1000), (12, 1)])
def test_substring_dedup(spark, monkeypatch, width, cap):
    """cap: different runs of one minimiser that go to one index; small ones lead over the trimmed and the counted path."""
    monkeypatch.setattr(substring_dedup, "SHARD_RUNS", cap)
    rows = awkward(5)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(documents(spark, rows), width).collect())
    assert got == windows_by_force(rows, width)
    assert sum(x[2] for x in got) > 50


def test_remove_repeats_leaves_others_alone(spark):
    rows = awkward(5)
    docs = documents(spark, rows)
    out = substring_dedup.remove_repeats(docs, 12)
    assert out.columns == docs.columns and out.count() == docs.count()
    untouched = windows_by_force(rows, 12)
    same = {(d, t) for d, t in rows if untouched[(d, len(words(t)), 0, " ".join(words(t)))]}
    assert same <= {(r["doc_id"], r["text"]) for r in out.collect()} | {(1000, None)}


def test_fm_index_counts(spark):
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5, int(n)) for n in rng.integers(4, 20, 12)]
    index = FMIndex(texts, 5)
    flat = index.symbols
    order = suffix_array(flat)
    assert sorted(order) == list(range(len(flat)))
    low, high = np.array([0]), np.array([index.n])
    for symbol in (2, 3):  # the pattern 3 2, read from its end
        low, high = index.extend(np.array([symbol]), low, high)
    assert high[0] - low[0] == sum(int(a == 3 and b == 2) for t in texts for a, b in zip(t, t[1:]))
    tree = WaveletMatrix(flat, 5)
    at = np.arange(len(flat) + 1)
    for s in range(5):
        assert ((tree.descend(np.full(len(at), s), at) - tree.descend(np.array([s]), np.array([0]))) == np.concatenate([[0], np.cumsum(flat == s)])).all()


def fingerprint_by_force(t):
    import xxhash

    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(rows, fps, radius=3):
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}
    of = defaultdict(set)
    for (d, _), f in zip(rows, fps):
        if d is not None:
            of[d].add(f)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[a] != root[b] and any((x ^ y).bit_count() <= radius for x in of[a] for y in of[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = awkward(9, 30) + [(2000 + k, "a b c d e f g h i j k l m n o p q r s t " + "z " * (k // 4)) for k in range(12)]
    fps = [fingerprint_by_force(t) for _, t in rows]
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    root = components_by_force(rows, fps)
    null = root[rows[1][0]]  # the row without an id is a copy of this one
    assert got == Counter((d, f, null if d is None else root[d]) for (d, _), f in zip(rows, fps))


def test_close_pairs_and_forest():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b111), base ^ np.uint64(0b1111 << 60), base ^ np.uint64(1 << 63)])
    for radius in (0, 1, 2, 3, 5):
        i, j = simhash.close_pairs(fps, radius)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want
    assert simhash.forest(6, np.array([0, 4, 4]), np.array([2, 5, 2])).tolist() == [0, 1, 0, 3, 0, 0]


def test_one_per_component(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "other words here now"), (None, "a b c d"), (5, None), (6, "")]
    out = simhash.one_per_component(documents(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 5]


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, line_dedup.rewrite_lines, substring_dedup.dedup_substrings, substring_dedup.remove_repeats, simhash.near_duplicates, simhash.one_per_component])
def test_empty_table(spark, run):
    assert run(documents(spark, [])).count() == 0
