"""Repair of the turn structure of conversations at least cost.

A conversation should be ``(s?(ua)+)?`` by its roles' initials. Turns may be kept (0), given
the role that fits (2) or deleted (3, required for blank and duplicate ones), and empty turns
inserted (2); a truncated turn that stays adds 1. The cheapest edits are found by a dynamic
program over four states (nothing yet, after s, u, a), in which an edit's initial fixes the
next state. So among equal costs the least audit comes from taking the least initial that
still reaches the least cost, turn by turn.

1. Turns, without their texts, are ordered by conversation, turn and hash in a range
   partitioning: a large conversation lies in many segments.
2. Each segment collapses equal consecutive role/fault symbols to runs. A run advances by the
   binary powers of its symbol's min-plus transition, which are cached. Conversations that
   lie inside the segment are finished at once; choices are unrolled for the audit.
3. Of conversations at a segment's ends each piece becomes one transition. These are chained
   backwards per conversation (a row a segment), which gives the cost still to come behind
   every piece; each piece then unrolls its audit for each state that it may be entered in,
   and a chain forwards picks those that meet.
4. Texts join their audit in a stream sorted by conversation, in bounded memory. A digest of
   a whole conversation is sequential by nature, so that one step goes by conversation; it
   holds nothing but the current turn.

Defined cases: null conv_id is a conversation of its own; a null in turn, role or text reads
as one space (turns that are null come first); rows with equal turns are ordered by the
SHA-256 of role and text; a role with another initial, or with none, can't be kept; a
conversation without rows has zeros, an empty audit and the empty text's digest; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from townwire.llm.common import stored

START, S, U, A = range(4)
FAR = 1 << 60
#: Costs of edits, by their initials; what an undeleted truncated turn adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: The state after a kept turn of each role; where none, it can't be kept. And the state after a turn of the role that fits.
KEPT = {("s", START): S, ("u", START): U, ("u", S): U, ("u", A): U, ("a", U): A}
FITTING = (U, U, A, U)
ACCEPTED = (0, FAR, FAR, 0)
#: Faults of a turn, the first that counts; DROPPED turns only name their conversation.
NONE, BLANK, TRUNCATE, DROPPED, DUPLICATE = range(5)
#: Turns of one conversation that a segment gathers to finish it at once; more go the way of pieces.
GATHER = 65_536
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

Matrix = tuple[tuple[int, ...], ...]
Symbol = tuple[str, int]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), FAR) for j in range(4)) for row in a)


def before(a: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to come before a transition, from those behind it."""
    return tuple(min(min(x + c for x, c in zip(row, costs)), FAR) for row in a)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if j == i else INSERT if j == FITTING[i] else FAR for j in range(4)) for i in range(4))
    return times(times(one, one), one)


INSERTS = _inserts()
END = before(INSERTS, ACCEPTED)


@lru_cache(maxsize=None)
def power(symbol: Symbol, k: int) -> Matrix:
    """The transition of 2^k turns of a symbol, with inserted turns before each."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    role, fault = symbol
    cost = [[DELETE if i == j else FAR for j in range(4)] for i in range(4)]
    if fault in (NONE, TRUNCATE):
        more = TRUNCATED * (fault == TRUNCATE)
        for i in range(4):
            cost[i][FITTING[i]] = min(cost[i][FITTING[i]], REROLE + more)
            if (role, i) in KEPT:
                cost[i][KEPT[role, i]] = more
    return times(INSERTS, tuple(map(tuple, cost)))


def powers(length: int) -> Iterator[int]:
    return (k for k in range(length.bit_length()) if length >> k & 1)


def runs_of(symbols: list[Symbol]) -> list[tuple[Symbol, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def transition(runs: list[tuple[Symbol, int]]) -> Matrix:
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, length in runs:
        for k in powers(length):
            out = times(out, power(symbol, k))
    return out


def unroll(runs: list[tuple[Symbol, int]], state: int, behind: tuple[int, ...], last: bool) -> tuple[str, int]:
    """The least audit from a state, and the state after it, where behind has the costs to come after the runs; last: no turn follows."""
    costs = [behind]
    for symbol, length in reversed(runs):
        at = costs[-1]
        for k in powers(length):
            at = before(power(symbol, k), at)
        costs.append(at)
    costs.reverse()
    out: list[str] = []
    for (symbol, length), after in zip(runs, costs[1:]):
        inside = [after]
        for _ in range(length):
            inside.append(before(power(symbol, 0), inside[-1]))
        inside.reverse()
        role, fault = symbol
        for here, after_one in zip(inside, inside[1:]):
            while True:
                if DELETE + after_one[state] == here[state]:
                    out.append("D")
                elif INSERT + here[FITTING[state]] == here[state]:
                    out.append("I")
                    state = FITTING[state]
                    continue
                elif (role, state) in KEPT and fault in (NONE, TRUNCATE) and TRUNCATED * (fault == TRUNCATE) + after_one[KEPT[role, state]] == here[state]:
                    out.append("K")
                    state = KEPT[role, state]
                else:
                    out.append("R")
                    state = FITTING[state]
                break
    while last and ACCEPTED[state]:
        out.append("I")
        state = FITTING[state]
    return "".join(out), state


def replay(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves; turns are (role, text) in order."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "K":
            state = KEPT[role[:1], state]
        elif edit != "D":
            state = FITTING[state]
            role = "user" if state == U else "assistant"
        if edit != "D":
            yield edit, role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the faults that crc32 of conv_id and turn asks for; dropped rows stay, marked. Adds columns conv and dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(text_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("fault", F.crc32(F.concat_ws(":", "conv", text_of("turn"))) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(text_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), F.lit(False).alias("dropped"))


def hashed(rows: DataFrame) -> DataFrame:
    """rows with a hash of role and text, which tells duplicates and orders equal turns."""
    return rows.withColumn("hash", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


class Measure:
    """Counts over the turns of a piece, in order."""

    FIELDS = "rows long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns long, first string, last string"

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least_turn = self.most_turn = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.join(1, fault == BLANK, fault == DUPLICATE, fault == TRUNCATE, 0, turn, turn, int(turn is not None), initial, initial)

    def join(self, rows, blank, duplicate, truncated, illegal, least_turn, most_turn, turns, first, last) -> None:
        if not rows:
            return
        self.illegal += illegal + (self.rows > 0 and f"{self.last}{first}" not in ("su", "ua", "au"))
        self.rows, self.blank, self.duplicate, self.truncated = self.rows + rows, self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if turns:
            self.turns += turns - (self.most_turn == least_turn)
            self.least_turn, self.most_turn = least_turn if self.least_turn is None else self.least_turn, most_turn
        self.first, self.last = first if self.first is None else self.first, last

    def summary(self) -> dict:
        gaps = self.most_turn - self.least_turn + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


REPAIRS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS = "segment int, place long, turn long, initial string, fault int, hash binary, seen boolean"


def measured(turns: list[tuple]) -> tuple[Measure, list[tuple[Symbol, int]]]:
    """Counts and runs of turns (turn, initial, fault) in order."""
    m, symbols = Measure(), []
    for turn, initial, fault in turns:
        if fault != DROPPED:
            m.add(turn, initial, fault)
            symbols.append(("", BLANK) if fault in (BLANK, DUPLICATE) else (initial, fault))
    return m, runs_of(symbols)


def finished(conv: str, turns: list[tuple]) -> dict:
    m, runs = measured(turns)
    return {"conv": conv, **m.summary(), "cost": before(transition(runs), END)[START], "audit": unroll(runs, START, END, True)[0]}


def segments(rows: DataFrame) -> DataFrame:
    """One row per conversation that lies in a segment (REPAIRS), and the turns of the others (ROWS, conv)."""
    rtrimmed = F.rtrim("text", F.lit(WHITE))
    fault = F.when(F.col("dropped"), DROPPED).when(rtrimmed == "", BLANK).when(F.right(rtrimmed, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATE)
    slim = hashed(rows).select("conv", "turn", "hash", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))
    ordered = slim.repartitionByRange("conv", F.asc_nulls_first("turn"), "hash", "row").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "hash")
    arrow = pa.schema([("conv", pa.string()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("segment", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("initial", pa.string()), ("fault", pa.int32()), ("hash", pa.binary()), ("seen", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place, conv, first, held, known = TaskContext.get().partitionId(), 0, None, True, [], set()

        def apart() -> list[dict]:
            out = [{"conv": conv, "segment": segment, "place": p, "turn": t, "initial": i, "fault": f, "hash": h, "seen": s} for p, t, i, f, h, s in held]
            held.clear()
            return out

        for batch in batches:
            out: list[dict] = []
            for name, turn, h, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if name != conv:
                    if conv is not None:
                        out += apart() if first else [finished(conv, [(t, i, f if f in (BLANK, DROPPED) or not s else DUPLICATE) for _, t, i, f, _, s in held])]
                        first = False
                    held.clear()
                    known.clear()
                    conv = name
                seen = h in known
                if fault != DROPPED:
                    known.add(h)
                held.append((place, turn, initial, fault, h, seen and fault != DROPPED))
                place += 1
                if len(held) >= GATHER:
                    out += apart()
                    first = True  # the rest of it goes the same way
            if first:
                out += apart()
            yield pa.RecordBatch.from_pylist(out, arrow)
        yield pa.RecordBatch.from_pylist(apart(), arrow)

    return ordered.select("conv", "turn", "hash", "initial", "fault").mapInArrow(run, f"{REPAIRS}, {ROWS}")


def chained(turns: DataFrame) -> DataFrame:
    """REPAIRS of conversations whose turns (conv, ROWS) lie in several segments."""
    fresh = turns.filter(~F.col("seen") & (F.col("fault") != DROPPED))  # at most one a segment for each hash
    rank = F.row_number().over(W.partitionBy("conv", "hash").orderBy("segment"))
    again = lambda dup: F.when((F.col("fault") != BLANK) & dup, DUPLICATE).otherwise(F.col("fault"))
    columns = ("conv", "segment", "place", "turn", "initial")
    flagged = fresh.withColumn("rank", rank).select(*columns, again(F.col("rank") > 1).alias("fault"))
    others = turns.filter(F.col("seen") | (F.col("fault") == DROPPED)).select(*columns, F.when(F.col("fault") == DROPPED, DROPPED).otherwise(again(F.lit(True))).alias("fault"))
    flagged = stored(flagged.unionByName(others), "turns-flagged")
    fields = [x.split()[0] for x in Measure.FIELDS.split(", ")]

    def ordered(t: pa.Table) -> tuple[Measure, list[tuple[Symbol, int]]]:
        t = t.sort_by("place")
        return measured(list(zip(*(t.column(k).to_pylist() for k in ("turn", "initial", "fault")))))

    def piece(t: pa.Table) -> pa.Table:
        m, runs = ordered(t)
        own = {"conv": t.column("conv")[0].as_py(), "segment": t.column("segment")[0].as_py(), "matrix": [x for row in transition(runs) for x in row]} | {k: getattr(m, k) for k in fields}
        return pa.Table.from_pylist([own], pa.schema([("conv", pa.string()), ("segment", pa.int32()), ("matrix", pa.list_(pa.int64())), *((k, pa.string() if k in ("first", "last") else pa.int64()) for k in fields)]))

    def matrix(flat: list[int]) -> Matrix:
        return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))

    def backwards(t: pa.Table) -> pa.Table:
        t, behind, out = t.sort_by([("segment", "descending")]), END, []
        for conv, segment, flat in zip(*(t.column(k).to_pylist() for k in ("conv", "segment", "matrix"))):
            out.append({"conv": conv, "segment": segment, "behind": list(behind), "ends": not out})
            behind = before(matrix(flat), behind)
        return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("segment", pa.int32()), ("behind", pa.list_(pa.int64())), ("ends", pa.bool_())]))

    def audits(t: pa.Table, after: pa.Table) -> pa.Table:
        _, runs = ordered(t)
        behind, ends = tuple(after.column("behind")[0].as_py()), after.column("ends")[0].as_py()
        each = [unroll(runs, state, behind, ends) for state in range(4)]
        own = {"conv": t.column("conv")[0].as_py(), "segment": t.column("segment")[0].as_py(), "audits": [a for a, _ in each], "to": [s for _, s in each]}
        return pa.Table.from_pylist([own], pa.schema([("conv", pa.string()), ("segment", pa.int32()), ("audits", pa.list_(pa.string())), ("to", pa.list_(pa.int64()))]))

    def forwards(t: pa.Table) -> pa.Table:
        whole, state, audit, behind = Measure(), START, [], END
        rows = t.sort_by("segment").to_pylist()
        for r in rows:
            whole.join(*(r[k] for k in fields))
            audit.append(r["audits"][state])
            state = r["to"][state]
        for r in reversed(rows):
            behind = before(matrix(r["matrix"]), behind)
        one = {"conv": rows[0]["conv"], **whole.summary(), "cost": behind[START], "audit": "".join(audit)}
        return pa.Table.from_pylist([one], pa.schema([("conv", pa.string()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]))

    by = ("conv", "segment")
    pieces = stored(flagged.groupBy(*by).applyInArrow(piece, f"conv string, segment int, matrix array<long>, {Measure.FIELDS}"), "turns-pieces")
    after = pieces.groupBy("conv").applyInArrow(backwards, "conv string, segment int, behind array<long>, ends boolean")
    options = flagged.groupBy(*by).cogroup(after.groupBy(*by)).applyInArrow(audits, "conv string, segment int, audits array<string>, to array<long>")
    return pieces.join(options, [*by]).groupBy("conv").applyInArrow(forwards, REPAIRS)


def repairs(rows: DataFrame) -> DataFrame:
    """REPAIRS, one row per conversation. rows: what damaged() or undamaged() gives."""
    seen = stored(segments(rows), "turns-segments")
    names = [x.split()[0] for x in REPAIRS.split(", ")]
    return seen.filter(F.col("audit").isNotNull()).select(*names).unionByName(chained(seen.filter(F.col("audit").isNull())).select(*names))


def replayed(rows: DataFrame, found: DataFrame, emit, schema: str) -> DataFrame:
    """A stream by conversation: emit(conversation's REPAIRS as a dict, iterator of its repaired (edit, role, text)) yields dicts of the schema, a few at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = [x.split()[0] for x in REPAIRS.split(", ")][1:]
    turns = hashed(rows.filter(~F.col("dropped"))).select("conv", F.lit(1).alias("kind"), "turn", "hash", "role", "text")
    both = found.withColumn("kind", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "hash").select("conv", "kind", "role", "text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist())
        out: list[dict] = []
        for _, own in groupby(stream, key=lambda r: r["conv"]):
            head = next(own)
            for one in emit(head, replay(head["audit"], ((r["role"], r["text"]) for r in own))):
                out.append(one)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.mapInArrow(run, schema)


def _conv_id(conv: str) -> int | None:
    return None if conv == " " else int(conv)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text."""

    def emit(head: dict, turns: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
        for place, (edit, role, text) in enumerate(turns):
            yield {"conv_id": _conv_id(head["conv"]), "place": place, "edit": edit, "role": role, "text": text}

    return replayed(rows, repairs(rows), emit, "conv_id long, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, faults, cost, audit and the SHA-256 of its repaired ``role:text`` lines."""

    def emit(head: dict, turns: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
        digest, between = hashlib.sha256(), b""
        for _, role, text in turns:
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        yield {"conv_id": _conv_id(head["conv"]), "repaired_sha256": digest.hexdigest()} | {k: head[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}

    return replayed(rows, repairs(rows), emit, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
