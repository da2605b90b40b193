"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three transducers are compiled from the model: the normaliser (identity character map,
space to meta symbol, dummy prefix), the piece transducer (one path per piece, spelled in
characters) and byte fallback (a character outside the alphabet to its byte pieces).
Composed with an input they give a lattice over its positions. Weights live in the tropical
semiring (min, +). For a byte-pair model the weight sits on pairs of arcs: two pieces may
follow each other at weight 0 if merging their joined text leaves exactly that pair, else
at infinity. Every prefix of a text then has one finite path, which is its encoding, so
arcs are followed the longest first, and no position is come to twice.

Pieces never hold the meta symbol behind another character, and characters outside the
alphabet join no piece; both are checked when the model is compiled. Inputs are cut before
meta symbols, and words between letters or digits and other characters, unless they hold one
of the few pairs of characters that a piece has across such a border. A worker keeps bounded
memos of words and of parts that it has already composed.

Defined cases: a null or empty text has no ids and decodes to ''; null and repeated doc_ids
are encoded like others; no text is cut off.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from townwire.llm.common import map_slices, texts

META = "▁"
#: Words, their parts, and pairs of pieces, that a worker keeps.
MEMO_WORDS, MEMO_PARTS, MEMO_PAIRS = 250_000, 350_000, 400_000
SCHEMA = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids array<int>"


class PieceTransducer:
    """Normaliser, pieces and byte fallback of one byte-pair model, compiled for composition."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id_of, self.byte_id = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id_of[piece] = i
        self.rank = {p: -model.get_score(i) for p, i in self.id_of.items()}
        self.alphabet = {p for p in self.id_of if len(p) == 1}
        if len(self.byte_id) != 256 or any(c not in self.alphabet for p in self.id_of for c in p):
            raise ValueError("the model has characters outside its alphabet, or no byte fallback")
        if any(META in p.lstrip(META) for p in self.id_of):
            raise ValueError("a piece holds the meta symbol behind another character")
        self.runs = {p: i for p, i in self.id_of.items() if len(p) > 1 and not p.strip(META)}
        if any(p.startswith(META * 2) for p in self.id_of.keys() - self.runs.keys()) or len({r for p, r in self.rank.items() if len(p) > 1 and p not in self.runs} & {self.rank[p] for p in self.runs}):
            raise ValueError("runs of spaces don't merge last")
        self.rank = {p: r for p, r in self.rank.items() if p not in self.runs}
        if len({r for p, r in self.rank.items() if len(p) > 1}) < sum(len(p) > 1 for p in self.rank):
            raise ValueError("pieces share a rank")
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_id.items()} | {i: p.encode() for p, i in self.id_of.items()}
        self._compile_spines()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.arcs = {p: self.id_of[p] for p in self.right_spine}
        self.reach: dict[str, int] = {}  # the longest arc that starts with these three characters
        for p in self.arcs:
            if len(p) > 2:
                self.reach[p[:3]] = max(self.reach.get(p[:3], 2), len(p))
        # the next shorter arc that starts as an arc does
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.arcs), None) for p in self.arcs}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self._compile_cuts()

    def _compile_cuts(self) -> None:
        """Parts of words: letters and digits in a row, or other characters in a row, with a meta symbol before them. crossing: the pairs of characters that stand in a piece and cross such a border."""
        inner = {c for c in self.alphabet if c.isalnum()}
        own = "".join(map(re.escape, sorted(inner)))
        self.cut = re.compile(f"{META}?[{own}]+|{META}?[^{own}{META}]+|{META}").findall
        self.crossing = sorted({a + b for p in self.arcs for a, b in zip(p, p[1:]) if (a in inner) != (b in inner) and META not in (a, b)})

    def _compile_spines(self) -> None:
        """For each piece that its own characters merge to: the runs at its right and left edge, each with the rank that ends it."""
        self.right_spine, self.left_spine = {}, {}
        for piece in sorted(self.rank, key=lambda p: (len(p) > 1, self.rank[p])):
            if len(piece) == 1:
                self.right_spine[piece] = self.left_spine[piece] = [(piece, np.inf)]
                continue
            parts = self._merge(piece, stop=2)
            if len(parts) == 2 and all(p in self.right_spine for p in parts):  # else no merging leads to it
                a, b = parts
                self.right_spine[piece] = [*self.right_spine[b][:-1], (b, self.rank[piece]), (piece, np.inf)]
                self.left_spine[piece] = [*self.left_spine[a][:-1], (a, self.rank[piece]), (piece, np.inf)]

    def words(self, text: str) -> list[str]:
        """The normaliser: space and meta symbol are one, and each word has one before it, the first too."""
        return text.replace(META, " ").split(" ") if text else []

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        """Merge by rank, leftmost first, down to so many parts."""
        parts = list(text)
        while len(parts) > stop:
            rank, k = min((self.rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == np.inf:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, a: str, b: str) -> bool:
        """Is the weight of arc b after arc a 0?

        While both are being merged, the boundary stands between a character run on a's right
        spine and one on b's left spine. A merge across it fires if it ranks before both next
        steps; on a tie the one further left goes first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            if a not in self.arcs or b not in self.arcs:  # the start, or a character outside the alphabet
                self.pairs[key] = True
                return True
            known, rank = True, self.rank
            left, right = self.right_spine[a], self.left_spine[b]
            i = j = 0
            while known:
                x, x_ends = left[i]
                y, y_ends = right[j]
                across = rank.get(x + y)
                if across is not None and across < x_ends and across <= y_ends:
                    known = False
                elif x_ends == y_ends == np.inf:
                    break
                elif x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = known
        return known

    def shortest(self, part: str) -> tuple[int, ...]:
        """Ids on the path of weight 0 through the lattice of one part.

        Arcs are followed from the start, the longest first, and taken back where none goes on.
        As each position has one finite path, none is come to twice.
        """
        arcs, shorter, known, end = self.arcs, self.shorter.get, self.pairs.get, len(part)
        path: list[str] = []
        before, at, arc = "", 0, self._longest(part, 0)
        while True:
            while arc is not None:
                follow = known((before, arc))
                if follow or follow is None and self._follows(before, arc):
                    break
                arc = shorter(arc)
            else:
                arc = path.pop()
                at -= len(arc)
                before, arc = path[-1] if path else "", shorter(arc)
                continue
            path.append(arc)
            at += len(arc)
            if at == end:
                break
            before, arc = arc, self._longest(part, at)
        ids = []
        for arc in path:
            own = arcs.get(arc)
            if own is None:  # outside the alphabet: byte fallback
                ids.extend(map(self.byte_id.__getitem__, arc.encode()))
            else:
                ids.append(own)
        return tuple(ids)

    def _longest(self, part: str, at: int) -> str:
        """The longest arc that starts here; a character outside the alphabet is an arc of its own."""
        arcs = self.arcs
        for end in range(at + self.reach.get(part[at : at + 3], 2), at + 1, -1):
            if part[at:end] in arcs:
                return part[at:end]
        return part[at]

    def _run(self, n: int) -> list[int]:
        """Ids of n meta symbols in a row, merged leftmost first."""
        parts: list[str] = []
        for _ in range(n):
            parts.append(META)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.id_of[p] for p in parts]

    def compose(self, words: set[str]) -> None:
        """Bring words into the memo."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        memo, parts = self.memo, self.parts
        for word in words:
            if word not in memo:
                whole = any(pair in word for pair in self.crossing)
                found = [META + word] if whole else self.cut(META + word)
                for part in found:
                    if part not in parts:
                        parts[part] = self.shortest(part)
                memo[word] = parts[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(parts.__getitem__, found)))

    def encode(self, batch: list[str]) -> list[list[int]]:
        out, meta = [], self.id_of[META]
        for words in map(self.words, batch):
            self.compose(set(words))
            of = self.memo.__getitem__
            if "" not in words:
                out.append(list(chain.from_iterable(map(of, words))))
                continue
            ids: list[int] = []
            run = 0
            for word in words:
                if not word:
                    run += 1
                    continue
                own = of(word)
                if run:
                    alone = own[0] == meta
                    ids += self._run(run + alone)
                    own, run = own[alone:], 0
                ids += own
            out.append(ids + self._run(run))
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse: byte pieces to characters, meta symbol to space, the dummy prefix off."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: ids, their number and crc32 (little-endian unsigned 32-bit), and what they decode to. A map without shuffle."""

    def run(slices):
        import pyarrow as pa

        t = transducer(model)
        for x in slices:
            ids = t.encode(x["text"])
            back = [t.decode(i) for i in ids]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.cumsum(n)
            flat = np.fromiter(chain.from_iterable(ids), "<i4", int(n.sum()))
            yield {
                "doc_id": x["doc_id"],
                "n_chars": [len(text) for text in x["text"]],
                "n_pieces": n,
                "ids_crc32": [zlib.crc32(flat[b - k : b].tobytes()) for b, k in zip(ends, n)],
                "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in back],
                "round_trip": [text.replace(META, " ") == y for text, y in zip(x["text"], back)],
                "ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat)),
            }

    return map_slices(texts(docs), run, SCHEMA)
