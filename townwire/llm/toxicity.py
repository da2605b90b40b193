"""Toxicity by a weighted finite-state pattern grammar.

Words and marks are read as symbols (insult, threat, target, negation, reported speech, comma,
colon, end of a clause, other). Five small transducers are composed into one bimachine: an automaton that
reads forwards and one that reads backwards, each the composition of its patterns.

* insult: words and stems of the learned lexicon are insults with their learned weight;
* threat: words of violence are threats;
* target: a person named near an insult or threat, before or behind it, in its clause; a comma
  between them parts a threat from its target, but not an insult ("you, ...");
* negation: a negation shortly before it, with no comma between;
* reported speech: the clause reports, before or behind, what somebody said; a report also
  reaches over a colon to what it opens.

What is scored is a clause, by the patterns that it matches and not word by word: the
heaviest match counts in full, further ones half, a quarter and so on, so that a clause
never weighs more than twice its heaviest pattern. An insult at a target weighs more than a
bare insult, the weakest pattern; a threat without a target is none. Negated and reported
patterns weigh a quarter, so that one doesn't mark a text. A text's score is a logistic
curve over the sum of its clauses. A threat at a target weighs ``OVER_HALF`` times what
brings that curve to one half, as labels show too few of them to learn it.

Insults and their weights are learned from labelled rows: whole words whose documents are
labelled toxic far more often than not, and starts of words where several such words begin
so and none carries them alone. One pass over a bounded, stored sample counts them, in toxic
documents and in the others; the curve is fitted to the same sample. Scoring is one map over all documents.

Defined cases: a null or empty text scores what a text without matches scores; repeated
rows score alike; labels that are null or for unknown documents teach nothing, of several
for one doc_id the highest counts; without any usable label every text scores alike unless
threats match; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.common import append_columns, map_slices, stored, texts

#: Labelled rows that the grammar is fitted to (expected number; more are thinned by a hash of doc_id).
TRAIN_ROWS = 20_000
#: Least toxic documents for a stem (also as a share of all toxic ones), least log odds.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 5, 0.01, 2.5
#: Lengths of word starts that are tried as stems; the words that must begin so, and the most of a stem's documents that one of them may have.
STARTS, STEM_WORDS, STEM_SHARE = (4, 5, 6), 3, 0.6
TARGETS = frozenset("you your yours yourself u he she him her they them these those people du dich dir euch ihr tu te toi vous ils elles eux tú ti usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nobody nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say claimed reported called quoted alleged told wrote according insulted sagte sagt behauptete nannte dit disait déclaré dijo dice llamó".split())
#: Words that threaten. Forms that only tell what has happened aren't among them.
THREATS = frozenset(
    "kill kills killing murder murders murdering hurt hurts hurting beating stab stabs stabbing shoot shoots shooting destroy destroys destroying "
    "umbringen umbringe umbringst umbringt umzubringen töten töte tötest tötet schlagen schlage schlägst schlägt "
    "tuer tue tues tuent tuez tuons tuerai tueras tuera tuerons tuerez tueront frapper frappe frappes frappent frappez frapperai frappera frapperont "
    "matar mato matas mata matamos matan matando mataré matarás matará mataremos matarán golpear golpeo golpeas golpea golpean golpeando golpearé golpeará golpearán".split()
)
#: Spanish threats that hold their target.
AIMED = frozenset(f"{w}{p}" for w in ("matar", "golpear") for p in ("te", "le", "la", "lo", "os", "les", "las", "los"))
INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER, AIMED_THREAT, COMMA, COLON = SYMBOLS = range(10)
#: Words that a target and a negation reach.
NEAR_TARGET, NEAR_NEGATION = 4, 4
#: What the patterns note about an insult or threat.
TARGETED, NEGATED, REPORTED = 1, 2, 4
#: Factor of an insult at a target; of what is negated or reported; of each further match in a clause.
AT_TARGET, WEAKENED, FURTHER = 1.5, 0.25, 0.5
#: A threat's weight while the curve isn't known, and as a multiple of what brings it to one half.
THREAT_WEIGHT, OVER_HALF = 6.0, 1.25
PATTERNS = ("insult", "threat", "target", "negation", "report")
ENDS = frozenset(".!?;")
MARKS = "¡¿\"'“”‘’«»()[]{}<>.,;:!?…-–—*_~#%&$"


class Transducer:
    """States 0..n-1 from 0 on; step(state, symbol) gives the next state and the notes on the symbol."""

    def __init__(self, n: int, step):
        self.n, self.step = n, step

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; the notes of both hold."""

        def step(state: int, symbol: int):
            a, x = self.step(state // other.n, symbol)
            b, y = other.step(state % other.n, symbol)
            return a * other.n + b, x | y

        return Transducer(self.n * other.n, step)

    def table(self) -> list[list[tuple[int, int]]]:
        return [[self.step(s, x) for x in SYMBOLS] for s in range(self.n)]


def within(trigger: int, reach: int, note: int, past_comma: frozenset[int] = frozenset()) -> Transducer:
    """Notes the symbols within reach words behind a trigger in its clause; behind a comma only those of past_comma. States beyond reach have a comma behind them."""

    def step(state: int, symbol: int):
        left, parted = (state - reach, True) if state > reach else (state, False)
        if symbol in (END, COLON):
            return 0, 0
        if symbol == COMMA:
            return (reach + left if left and past_comma else 0), 0
        if symbol == trigger:
            return reach, 0
        after = reach + left - 1 if parted and left > 1 else 0 if parted else max(0, left - 1)
        return after, note if left and (not parted or symbol in past_comma) else 0

    return Transducer(2 * reach + 1, step)


def clause(trigger: int, note: int, past_colon: bool) -> Transducer:
    """Notes all symbols from a trigger to the end of its clause, or only to a colon."""
    ends = (END,) if past_colon else (END, COLON)
    return Transducer(2, lambda state, symbol: (0, 0) if symbol in ends else (1 if symbol == trigger else state, note if state else 0))


def aimed() -> Transducer:
    """Notes threats that hold their target."""
    return Transducer(1, lambda state, symbol: (0, TARGETED if symbol == AIMED_THREAT else 0))


def grammar(patterns: tuple[str, ...] = PATTERNS) -> tuple[list, list]:
    """The composed machines that read forwards and backwards: [state][symbol] -> next state, notes."""
    forwards = backwards = Transducer(1, lambda state, symbol: (0, 0))
    if "target" in patterns:
        near = within(TARGET, NEAR_TARGET, TARGETED, frozenset({INSULT}))
        forwards, backwards = forwards.compose(near).compose(aimed()), backwards.compose(near)
    if "negation" in patterns:
        forwards = forwards.compose(within(NEGATION, NEAR_NEGATION, NEGATED))
    if "report" in patterns:
        forwards, backwards = forwards.compose(clause(REPORT, REPORTED, True)), backwards.compose(clause(REPORT, REPORTED, False))
    return forwards.table(), backwards.table()


def pattern_weight(symbol: int, weight: float, notes: int) -> float:
    """What a matched pattern weighs."""
    if symbol == INSULT:
        weight *= AT_TARGET if notes & TARGETED else 1.0
    elif not notes & TARGETED:
        return 0.0
    return weight * WEAKENED if notes & (NEGATED | REPORTED) else weight


def bare(token: str) -> str:
    return token.strip(MARKS)


def stems(word: str) -> list[str]:
    """The word itself, marked by a closing space, and its starts."""
    return [word + " ", *(word[:n] for n in STARTS if len(word) > n)]


class Scorer:
    """Reads documents with the composed machines."""

    def __init__(self, lexicon: dict[str, float], threat: float = THREAT_WEIGHT, patterns: tuple[str, ...] = PATTERNS):
        self.lexicon = lexicon if "insult" in patterns else {}
        self.forwards, self.backwards = grammar(patterns)
        self.words = {w: (TARGET, 0.0) for w in TARGETS} | {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS}
        if "threat" in patterns:
            self.words |= {w: (THREAT, threat) for w in THREATS} | {w: (AIMED_THREAT, threat) for w in AIMED}
        self.known: dict[str, tuple[int, float, int]] = {}

    def read(self, token: str) -> tuple[int, float, int]:
        """A token's symbol, its weight, and the mark behind it: END, COLON, COMMA or, for none, OTHER."""
        word = bare(token)
        weight = max((self.lexicon[s] for s in stems(word) if s in self.lexicon), default=0.0)
        symbol, weight = (INSULT, weight) if weight else self.words.get(word, (OTHER, 0.0))
        marks = token[len(token.rstrip(MARKS)) :]
        return symbol, weight, OTHER if not marks else END if not ENDS.isdisjoint(marks) else COLON if ":" in marks else COMMA if "," in marks else OTHER

    def clauses(self, text: str) -> float:
        """The sum of the scores of matched clauses."""
        tokens = text.lower().replace("\n", " . ").split()
        known, read = self.known, self.read
        for t in set(tokens):
            if t not in known:
                if len(known) > 300_000:
                    known.clear()
                known[t] = read(t)
        symbols = [known[t] if t in known else read(t) for t in tokens]
        total, begin, live = 0.0, 0, False
        for i, (_, weight, mark) in enumerate(symbols):
            live = live or weight > 0
            if mark == END or i == len(symbols) - 1:
                if live:
                    total += self.clause(symbols[begin : i + 1])
                begin, live = i + 1, False
        return total

    def clause(self, symbols: list[tuple[int, float, int]]) -> float:
        """The patterns that one clause matches, of each part between colons the heaviest in full and further ones less and less."""
        read = [x for symbol, weight, mark in symbols for x in ([(symbol, weight)] if mark in (OTHER, END) else [(symbol, weight), (mark, 0.0)])]
        behind, state = [], 0
        for symbol, _ in reversed(read):
            state, notes = self.backwards[state][symbol]
            behind.append(notes)
        parts, state = [[]], 0
        for (symbol, weight), after in zip(read, reversed(behind)):
            state, notes = self.forwards[state][symbol]
            if weight:
                parts[-1].append(pattern_weight(symbol, weight, notes | after))
            elif symbol == COLON:
                parts.append([])
        return sum(w * FURTHER**k for matched in parts for k, w in enumerate(sorted(matched, reverse=True)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by `rows`


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n, clean): in how many of the texts of toxic and of other rows each word occurs; each task adds its own up first."""

    def run(slices):
        n: Counter = Counter()
        clean: Counter = Counter()

        def summed():
            words = list(n.keys() | clean.keys())
            return {"word": words, "n": [n[w] for w in words], "clean": [clean[w] for w in words]}

        for x in slices:
            for text, toxic in zip(x["text"], x["toxic"]):
                (n if toxic == 1 else clean).update({w for w in {bare(t) for t in text.lower().split()} if w})
            if len(n) + len(clean) > 400_000:
                yield summed()
                n.clear()
                clean.clear()
        yield summed()

    return map_slices(rows.select("text", "toxic"), run, "word string, n long, clean long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def count_stems(words: DataFrame) -> DataFrame:
    """(stem, n, kinds, most, clean): toxic documents of the words that begin so (once for each such word), the number of words, the documents of the commonest, and other documents."""
    word = F.col("word")
    starts = F.array(F.concat(word, F.lit(" ")), *(F.when(F.char_length(word) > n, F.left(word, F.lit(n))) for n in STARTS))
    each = words.select(F.explode(F.filter(starts, lambda s: s.isNotNull())).alias("stem"), "n", "clean")
    return each.groupBy("stem").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds"), F.max("n").alias("most"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float, float, float]:
    """The insult lexicon, slope and offset of the logistic curve, and a threat's weight."""
    sample = stored(training_rows(docs, labels, rows), "sample")
    toxic, clean = sample.filter("toxic = 1").dropDuplicates(["text"]), sample.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    productive = F.col("stem").endswith(" ") | ((F.col("kinds") >= STEM_WORDS) & (F.col("most") <= STEM_SHARE * F.col("n")))
    counted = toxic.select("text", "toxic").union(sample.filter("toxic = 0").select("text", "toxic"))
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    often = count_stems(count_words(counted)).filter((F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n_toxic)) & productive)
    # as many as the bounded sample gives: each stem lies in a hundredth of its toxic texts
    lexicon = {r["stem"]: r["odds"] for r in often.select("stem", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS).collect()}

    def run(slices):
        scorer = Scorer(lexicon)
        for x in slices:
            yield {"x": [math.log1p(scorer.clauses(t)) for t in x["text"]], "toxic": x["toxic"]}

    # equal scores are summed first; at most one row per row of the sample
    points = map_slices(sample.select("text", "toxic"), run, "x double, toxic int").groupBy("x").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()
    slope, offset = logistic(np.array([(p["x"], p["n"], p["k"]) for p in points], float).reshape(-1, 3))
    half = math.expm1(-offset / slope) if slope > 0 and 0 < -offset / slope < 5 else THREAT_WEIGHT / OVER_HALF
    return lexicon, slope, offset, OVER_HALF * half


def logistic(points: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge; points: x, rows, toxic rows."""
    if not len(points):
        return 1.0, -4.0
    x, n, k = points.T
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        gradient = design @ (k - n * p) - 1e-2 * w
        hessian = (design * (n * p * (1 - p))) @ design.T + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    score = scoring(docs, labels, rows)

    def run(slices):
        of = score()
        for x in slices:
            own = of(x["text"])
            yield {"doc_id": x["doc_id"], "score": own, "predicted": [int(s >= 0.5) for s in own]}

    scored = map_slices(texts(docs), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows that score 0.5 or more, in all their columns."""
    score = scoring(docs, labels, rows)
    made = append_columns(docs, ["text"], lambda x: {"_townwire_score": score()([t or "" for t in x["text"]])}, "_townwire_score double")
    return made.filter("_townwire_score < 0.5").select(*docs.columns)


class scoring:
    """Fits at once; called in a task, it gives the function from texts to scores, which the worker keeps."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int):
        self.fitted = fit(docs, labels, rows)
        self.of = None

    def __call__(self):
        if self.of is None:
            lexicon, slope, offset, threat = self.fitted
            scorer = Scorer(lexicon, threat)
            self.of = lambda batch: [1 / (1 + math.exp(-max(-30.0, min(30.0, slope * math.log1p(scorer.clauses(t)) + offset)))) for t in batch]
        return self.of
