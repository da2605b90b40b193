"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is tried alone: where it is one pre-token and the full
tokenizer gives exactly one id for it, it is *proven*. Online, a text is only cut into
pre-tokens; proven ones count 1 without any merging, and the others are merged once and
their counts kept in a bounded memo.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows with a null or repeated
doc_id are counted like any other; special strings inside a text are one token each, which
is the library's default; no text is cut, however long.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from townwire.llm.bytepair import PRETOKEN, encoder
from townwire.llm.common import map_slices, texts

#: Pre-tokens whose merged counts a worker keeps; beyond it the memo starts anew.
MEMO = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ids = encoder(path)._encode_single_piece
        self.vocabulary = {self.library.decode([i], skip_special_tokens=False) for i in range(self.library.get_vocab_size())}
        self.find = regex.compile(PRETOKEN).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.proven = self._prove()
        self.known: dict[str, int] = {}
        self._reset()

    def _prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the merges bring to one id."""
        alone = [s for s in self.vocabulary if s and s not in self.special and self.find(s) == [s]]
        return frozenset(s for s, e in zip(alone, self.library.encode_batch(alone, add_special_tokens=False)) if len(e.ids) == 1)

    def _reset(self) -> None:
        self.known = dict.fromkeys(self.proven, 1)

    def merge(self, pieces: list[str]) -> None:
        """Count by merging what the shortcut doesn't cover. A vocabulary string without proof goes to the library itself."""
        for piece in pieces:
            self.known[piece] = len(self.library.encode(piece, add_special_tokens=False).ids if piece in self.vocabulary else self.ids(piece))

    def counts(self, batch: list[str]) -> list[int]:
        found, extra = [], []
        for text in batch:
            if self.cut and any(s in text for s in self.special):
                parts = self.cut(text)
                found.append([p for part in parts for p in self.find(part)])
                extra.append(len(parts) - 1)
            else:
                found.append(self.find(text))
                extra.append(0)
        if len(self.known) > MEMO + len(self.proven):
            self._reset()
        self.merge([p for p in set().union(*found) if p not in self.known])
        of = self.known.__getitem__
        return [sum(map(of, x)) + n for x, n in zip(found, extra)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). A map without shuffle."""

    def run(slices):
        count = counter(vocabulary)
        for x in slices:
            n = count.counts(x["text"])
            yield {"doc_id": x["doc_id"], "n_bytes": [len(t.encode()) for t in x["text"]], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return map_slices(texts(docs), run, SCHEMA)
