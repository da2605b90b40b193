"""A byte-level byte-pair vocabulary file as a fast encoder with the same ids."""

from __future__ import annotations

import json
from functools import lru_cache

#: The pre-token pattern of this kind of vocabulary. Fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that such files use for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A tiktoken encoding of the file. Ids must rise in merge order, which is checked, as ids then are merge ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: not a byte-level vocabulary with ids in merge order")
    of = byte_of_char()
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
