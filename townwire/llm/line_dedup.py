"""Line dedup with two Bloom filters.

1. Every document sends the 64-bit hashes of its distinct line keys, each at most twice per
   task, to the shard of the filters that the hash falls into. A shard's first filter notes
   hashes seen once, its second those that met a set bit in the first: seen twice.
2. The second filters (sized by the number of lines, up to a bound) go to all tasks. Only
   lines whose key tests positive there, suspected repeats, leave the documents, as
   (digest, doc_id). Their exact counts confirm them and pick the occurrence to keep; a
   false positive of the filters is counted once and stays. Fuller filters only let more
   lines be counted.
3. Documents get the digests that they lose and drop those lines.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines but
those in the largest doc_id that holds the key.

Defined cases: a null or empty text is one empty line; rows with the same doc_id are one
document to the counts and are rewritten each; rows with a null doc_id are neither counted
nor changed; empty tables give no rows; lines and texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.bloom import Twice, bits_for, twice_filters
from townwire.llm.common import append_columns, join_counted, map_slices, stored, texts, with_text

SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: str, min_chars: int) -> list[bytes | None]:
    """Per line its key, None where that is too short."""
    out = []
    for line in text.encode().split(b"\n"):
        key = line.strip(SPACE).lower()
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars)
        out.append(key if long_enough else None)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def distinct_keys(doc_id: int | None, text: str, min_chars: int) -> list[bytes]:
    return [] if doc_id is None else list({k for k in keys_of(text, min_chars) if k})


def suspects(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(key, doc_id) of the distinct keys of each document that may be repeated."""
    filters = twice_filters(texts(docs), lambda x: [hashes(distinct_keys(d, t, min_chars)) for d, t in zip(x["doc_id"], x["text"])], bits)
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # a bounded number of bits

    def run(slices):
        twice = Twice(sent.value, bits)
        for x in slices:
            keys, ids = [], []
            for doc_id, text in zip(x["doc_id"], x["text"]):
                own = distinct_keys(doc_id, text, min_chars)
                keys += own
                ids += [doc_id] * len(own)
            if keys:
                hit = np.flatnonzero(twice.test(hashes(keys)))
                yield {"key": [digest(keys[i]) for i in hit], "doc_id": [ids[i] for i in hit]}

    return map_slices(texts(docs), run, "key binary, doc_id long")


def lost_keys(docs: DataFrame, min_chars: int, min_docs: int, bits: int | None = None) -> DataFrame:
    """(doc_id, keys) of the documents that lose lines."""
    if bits is None:
        ends = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n")))
        bits = bits_for(texts(docs).agg(F.coalesce(F.sum(ends + 1), F.lit(0))).first()[0])
    found = stored(suspects(docs, min_chars, bits), "suspects")
    # in two steps, as a document may come in several rows: pairs first, then documents per key
    repeated = found.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("kept")).filter(F.col("n") >= min_docs)
    repeated = stored(repeated, "repeated")
    return join_counted(found, repeated, "key", "n", found.count()).filter("doc_id <> kept").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def without(text: str, lost: list[bytes] | None, min_chars: int) -> list[str]:
    """The lines that stay."""
    lines = text.split("\n")
    if not lost:
        return lines
    gone = set(lost)
    return [line for line, k in zip(lines, keys_of(text, min_chars)) if k is None or digest(k) not in gone]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, and the kept text."""

    def run(slices):
        for x in slices:
            n = [t.count("\n") + 1 for t in x["text"]]
            kept = [without(t, lost, min_chars) for t, lost in zip(x["text"], x["keys"])]
            yield {"doc_id": x["doc_id"], "n_lines": n, "n_dropped": [a - len(k) for a, k in zip(n, kept)], "kept": ["\n".join(k) for k in kept]}

    joined = texts(docs).join(lost_keys(docs, min_chars, min_docs), "doc_id", "left")
    return map_slices(joined, run, "doc_id long, n_lines long, n_dropped long, kept string")


def rewrite_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the kept lines as their text, in all their columns. A null text stays null."""
    lost = lost_keys(docs, min_chars, min_docs).select(F.col("doc_id").alias("_townwire_id"), F.col("keys").alias("_townwire_keys"))
    joined = docs.join(lost, docs["doc_id"] == lost["_townwire_id"], "left")
    rewrite = lambda x: {"_townwire_text": [t if t is None else "\n".join(without(t, k, min_chars)) for t, k in zip(x["text"], x["_townwire_keys"])]}
    return with_text(append_columns(joined, ["text", "_townwire_keys"], rewrite, "_townwire_text string"), docs.columns, "_townwire_text")
