"""Large lexicons: what passes the filter is asked of the lexicon, texts left open go through automata in parts."""

import glob
import os
import random
from functools import partial

import duckdb
import numpy as np
import pytest

from townwire.operators import automaton, sieve
from townwire.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_large_lexicon_gives_the_rows_of_its_sql_without_cutting_texts(spark, monkeypatch):
    """Each text was sent to the parts of all its n-grams, and walked there stretch by stretch: more than a part's surfaces took, and more for more conversations."""
    monkeypatch.setattr(automaton, "longest_hits", partial(automaton.longest_hits, part_tokens=1_000))
    monkeypatch.setattr(automaton, "_cut", None)
    got = sorted(tuple(r) for r in registry.QUERIES["lexicon_automaton"](spark, SF).collect())
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert got == sorted(duck.sql(registry.ORACLES["lexicon_automaton"]).fetchall()) and len(got) > 500


def odd(rng: random.Random, names: list[str], most: int) -> str:
    return "".join(rng.choice(names) + rng.choice([" ", " ", " ", "  ", "\t", "\xa0", "\n", ", ", "-", ""]) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("filter_", ["as built", "all pass"])
def test_any_filter_gives_the_rows_of_one_automaton(spark, monkeypatch, filter_, tmp_path):
    """Surfaces of one to six tokens, namesakes, equal lengths by ord, letters whose lower case is longer; a filter that lets all pass leaves texts open, which go through parts."""
    rng = random.Random(8)
    names = ["".join(rng.choices("abÉ", k=rng.randint(1, 2))) for _ in range(40)] + ["İ", "ß", "Σ", "aΣ", "\U0001f600", "\x00", "_", "٣", "é"]
    surfaces = list({odd(rng, names, 6).strip() for _ in range(400)} | {" a", "a ", "İ", "i̇", ""})
    lexicon = [(s, f"e{i}{copy}", rng.choice(["local", "other"]), rng.choice([None, 1, 2])) for i, s in enumerate(surfaces) for copy in range(rng.randint(1, 2))]
    lex = spark.createDataFrame(lexicon, "surface string, entity_id string, region string, ord int")
    texts = [*((i, odd(rng, names, 25)) for i in range(400)), (400, None), (401, "\x00"), (None, " ".join(surfaces[:2])), (402, odd(rng, names, 20_000)), (403, " ".join(odd(rng, names, 20_000) for _ in range(20)))]
    assert len(texts[-1][1]) > 1.5 * sieve.SLICE_CHARS  # read in pieces
    df = spark.createDataFrame(texts, "k long, t string")
    want = sorted(map(repr, automaton.longest_hits(df, lex, "k", "t").collect()))
    left = []
    whole = automaton._in_parts
    monkeypatch.setattr(automaton, "_in_parts", lambda texts, *a: left.append(texts.count()) or whole(texts, *a))
    if filter_ == "all pass":
        size = sieve.SHARD_BITS // 8
        monkeypatch.setattr(sieve, "build", lambda rows, n: lambda: sieve.Sieve(np.full(size, 255, np.uint8), 1))
    for folder in (None, f"file://{tmp_path}/own"):
        assert sorted(map(repr, automaton.longest_hits(df, lex, "k", "t", 30, folder).collect())) == want and len(want) > 300
    assert all(n < 20 for n in left) if filter_ == "as built" else left[0] > 50


def test_a_text_sends_a_handful(spark):
    """However long it is, and however often it repeats itself."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4_000)]
    text = " ".join([*words, *words[:50] * 20])
    lex = spark.createDataFrame([(f"{a} {b}",) for a, b in zip(words[::40], words[1::40])], "surface string").selectExpr("surface", "'e' as entity_id", "'local' as region", "0 as ord", "lower(surface) as low", "2 as n")
    rows = lex.mapInArrow(lambda batches: sieve.hashed(b.select([0, 1, 2, 3]) for b in batches), "surface string, entity_id string, region string, ord int, low string, n int, hash long")
    own = sieve.build(rows, 400_000)()
    assert own.shards == 8
    cut = sieve.Slice([text, "", words[0]])
    at, back, a, b = sieve.chosen(cut, own, [2])
    sent = {cut.text[i:j] for i, j in zip(a.tolist(), b.tolist())}
    held = sorted({f"{a} {b}" for a, b in zip(words[::40], words[1::40])}, key=len, reverse=True)
    least = len(held[sieve.SENT + 5_000 // sieve.MORE_TOKENS - 1])
    assert set(at.tolist()) == {0} and sent == {s for s in held if len(s) >= least} and back[0] == max(len(s) for s in held if len(s) < least)


def test_hashes_and_tokens_are_those_of_the_strings():
    import regex

    from townwire.operators.lexicon import TOKEN

    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = sieve.kinds()[np.frombuffer(signs.encode("utf-32-le"), np.uint32)]
    single = {m.start() for m in regex.finditer(r"[^\s\p{L}\p{N}_]", signs)}
    word = {i for m in regex.finditer(r"[\p{L}\p{N}_]+", signs) for i in range(*m.span())}
    assert set(np.flatnonzero(table == sieve.OTHER).tolist()) == single and set(np.flatnonzero(table == sieve.WORD).tolist()) == word
    rng = random.Random(10)
    lows = [odd(rng, ["ab", "é", "\U0001f600", "٣_"], 12).lower() for _ in range(200)]
    cut = sieve.Slice(lows)
    spots = [m.span() for m in regex.finditer(TOKEN, cut.text)]
    assert spots == list(zip(cut.starts.tolist(), cut.ends.tolist()))
    assert np.diff(cut.first).tolist() == [len(regex.findall(TOKEN, t)) for t in lows]
    one = sieve.Slice(["ab\té"])
    again = sieve.Slice(["x", "", "é ab é ab"])
    assert one.hashes(np.array([0]), np.array([4])) == again.hashes(np.array([5]), np.array([9])) != again.hashes(np.array([6]), np.array([9]))


def test_pieces_of_a_long_text_hold_all_its_n_grams():
    import regex

    from townwire.operators.lexicon import TOKEN

    def grams(text):
        spots = [m.span() for m in regex.finditer(TOKEN, text)]
        return {text[a : spots[i + n - 1][1]] for n in (1, 2, 5) for i, (a, _) in enumerate(spots) if i + n <= len(spots)}

    rng = random.Random(11)
    for _ in range(50):
        text = odd(rng, ["ab", "é", "cde", "_f"], 300)
        found = list(sieve.pieces(text, 5, 40))
        assert set().union(*map(grams, found)) == grams(text) and (len(text) < 200 or len(found) > 2) and all(len(p) < 400 for p in found)
    assert list(sieve.pieces("", 2)) == [""] and list(sieve.pieces("ab" * 100, 2, 10)) == ["ab" * 100]
