"""Token counts, piece encoding and packing against the libraries and a round trip."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, documents
from townwire.llm import packing, pieces, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "<|endoftext|>x<|endoftext|>", "<s> </s> <0x0A>", "日本語 のテキスト", "😀é́", "▁a ▁▁b", "a" * 3000, " " * 37 + "y", "\n\n\t x", "it's WE'LL 123 4,5"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts(spark, library):
    rows = awkward() + list(enumerate(ODD, 5000))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(documents(spark, rows), BYTES).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((d or -1, len((t or "").encode()), k, k > 512) for (d, t), k in zip(rows, n))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_of_any_text(text):
    c = token_counts.counter(BYTES)
    assert c.counts([text]) == [len(c.library.encode(text, add_special_tokens=False).ids)]


def test_memo_starts_anew(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    c = token_counts.Counter(BYTES)
    texts = [f"zyxq{i} wvut{i}" for i in range(40)]
    for _ in range(2):
        assert [c.counts([t])[0] for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces(spark, processor):
    rows = awkward() + list(enumerate(ODD, 5000))
    got = {(r["doc_id"], r["n_chars"]): r for r in pieces.encode_pieces(documents(spark, rows), PIECES).collect()}
    for d, t in rows:
        ids, r = processor.encode(t or ""), got[d, len(t or "")]
        assert list(r["ids"]) == ids and r["n_pieces"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == hashlib.sha256(processor.decode(ids).encode()).hexdigest() and r["round_trip"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁aeotnz.\n"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_of_any_text(text):
    t, sp = pieces.transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = t.encode([text])[0]
    assert ids == sp.encode(text) and t.decode(ids) == sp.decode(ids)


def test_pieces_look_up_few_arcs(processor):
    """Arcs are followed the longest first: under four look-ups a character, in words that arcs lead astray too."""

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

    t = pieces.PieceTransducer(PIECES)
    t.pairs, t.arcs = Counted(t.pairs), Counted(t.arcs)
    rng = random.Random(5)
    syllables = ["tion", "er", "and", "th", "cion", "oni", "ing", "str", "ieu", "é", "q", "²."]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 40))) for _ in range(500)]
    assert t.encode(words) == [processor.encode(w) for w in words]
    assert t.pairs.asked + t.arcs.asked < 4 * sum(map(len, words))


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, library, capacity):
    rows = awkward() + list(enumerate(ODD, 5000))
    got = packing.pack(documents(spark, rows), BYTES, capacity).collect()
    want = []
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(d or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // capacity) * 1.1 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    np.add.at(counts, rng.integers(1, 1025, 5000) if seed % 2 else np.clip(rng.lognormal(5.5, 1, 5000).astype(int), 1, 1024), 1)
    runs = packing.plan(counts, 1024)
    sequences = runs["sequence"].max() + 1
    placed = sum(packing.best_fit(counts, 1024).values())
    least = -(-(counts * np.arange(1025)).sum() // 1024)
    assert sequences <= placed and sequences * 1024 >= (counts * np.arange(1025)).sum()
    assert sequences <= least * 1.05 + 1


def test_fit_reaches_a_small_optimum():
    x = packing.fit([(3, 1), (2, 2), (3,)], np.array([0.0, 4, 6, 10]), rounds=2000)
    assert np.allclose(x, [4, 3, 6], atol=1e-2)


@pytest.mark.parametrize("run", [lambda d: token_counts.token_counts(d, BYTES), lambda d: pieces.encode_pieces(d, PIECES), lambda d: packing.pack(d, BYTES)])
def test_empty_table(spark, run):
    assert run(documents(spark, [])).count() == 0
