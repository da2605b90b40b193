"""Small document tables with every awkward row, and columns whose names operators use inside."""

from __future__ import annotations

import random

CLASHING = ("row", "keys", "key", "fp", "spans", "n", "range", "next_text", "entries", "bucket", "score")


def documents(spark, rows, clash=True):
    """(doc_id, text) rows as documents, with further columns of clashing names."""
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{c} string" for c in CLASHING if clash)]
    full = [(d, t, "en", "s", None if t is None else len(t), *("x" for _ in CLASHING if clash)) for d, t in rows]
    return spark.createDataFrame(full, ", ".join(names))


def awkward(seed: int = 3, n: int = 40):
    """Nulls, empty and blank texts, one long text, equal texts, repeated rows, shared lines and passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(45))
    shared = [" ".join(word() for _ in range(8)) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([f"  {s.upper() if s.isascii() else s}\t" for s in shared] + shared))
        if rng.random() < 0.25:
            lines.append(passage)
        rows.append((i * 7 % n * 3, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, rows[0][1]), (1004, rows[0][1] + " x"), (1005, " ".join(word() for _ in range(5000))), (1006, "one"), (1006, "one"), (None, rows[1][1])]
    return rows
