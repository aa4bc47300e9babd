"""Toxicity by a weighted finite-state grammar over the clauses of a text.

A clause is read as a tape of word classes with strengths. Five transducers, each reading what the one before wrote, are
composed: the insult transducer keeps a word as an insult or dismisses it; the target transducer turns an insult near a
target into abuse; the threat transducer turns a verb of harm near a target into a menace or takes it as a figure of
speech; the negation transducer rewrites an insult, abuse or menace that follows a negation as denied, or passes it on at
a price that falls with the distance; the reported-speech transducer does so after a verb of saying. Arcs compete: the
path of the greatest weight is the reading of the clause, and that weight and its marks are what is scored, never words
by themselves. Insult words and word beginnings with their strengths, the weights of the arcs and how much the marks
count are learned from labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.llm.labelled import SAMPLE_ROWS, fold, labelled_sample
from regiometric.llm.words import slices, tidy
from regiometric.session import stage

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
MOST_LEXEMES = 4000
MOST_CANDIDATES = 60_000
LEAST_DOCUMENTS = 5
LEAST_WEIGHT = 2.5
CACHED_WORDS = 300_000
PREFIXES = range(3, 9)

# Seed words of the closed classes; the open class of insults is learned.
THREATS = frozenset("kill hurt destroy beat shoot stab töten schlagen umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your u ur he she they du dich dein ihr sie tu toi vous ton tú usted vosotros".split())
NEGATIONS = frozenset("not no never nobody without nicht kein keine nie pas jamais sans nunca jamás sin".split())
SAYING = frozenset("said says say claims claimed wrote called sagt sagte dit disait dijo dice".split())
ENDS = frozenset(".!?;:|")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")

# Classes of words, then what the transducers make of insults and verbs of harm.
PLAIN, INSULT, THREAT, TARGET, NEGATION, SAID, ABUSE, MENACE, DENIED, QUOTED = range(10)
MARKS = ("insult", "abuse", "menace", "denied", "quoted")
MARK_OF = {INSULT: 0, ABUSE: 1, MENACE: 2, DENIED: 3, QUOTED: 4}
EVENTS = (INSULT, ABUSE, MENACE)
ANY = -1
#: The kinds of weighted arcs, and what they weigh before learning.
PRIOR = {
    "insult": 1.0, "harmless": 1.0, "aimed": 0.5, "menace": 1.5, "figurative": 0.3, "denied": 0.5, "despite denial": -4.0,
    "quoted": 0.5, "despite quotation": -3.0,
}
KINDS = list(PRIOR)
ROUNDS = 3
ARC_PENALTY = 20.0
#: A kind of arc, how often it counts, and how often for each unit of the word's strength.
Count = tuple[str, float, float]
#: Arcs by state and symbol: (next state, symbol written or None for the one read, what counts).
Arcs = dict[tuple[str, int], list[tuple[str, int | None, tuple[Count, ...]]]]


@dataclass(frozen=True)
class Transducer:
    """A weighted machine over symbols; a state without arcs for a symbol uses those for ``ANY``. Paths that end in a
    state of ``waiting`` are no readings."""

    start: str
    arcs: Arcs
    waiting: frozenset[str] = frozenset()

    def moves(self, state: str, symbol: int) -> list[tuple[str, int | None, tuple[Count, ...]]]:
        return self.arcs[(state, symbol)] if (state, symbol) in self.arcs else self.arcs[(state, ANY)]


def insults() -> Transducer:
    """Keeps an insult, which weighs by its strength, or dismisses it."""
    kept, dismissed = ("i", INSULT, (("insult", 0.0, 1.0),)), ("i", PLAIN, (("harmless", 1.0, 0.0),))
    return Transducer("i", {("i", INSULT): [kept, dismissed], ("i", ANY): [("i", None, ())]})


def pointed(symbol: int, out: int, kind: str, otherwise: int, cost: tuple[Count, ...], reach: int) -> Transducer:
    """Rewrites ``symbol`` as ``out`` if a target stands at most ``reach`` words before or after it, the nearer the
    weightier; the other reading of it is ``otherwise``, which counts ``cost``.

    State ``s<k>`` remembers a target for k more words; ``w<k>`` has promised one within k words.
    """
    arcs: Arcs = {}
    for left in range(reach + 1):
        here, after = f"s{left}", f"s{max(left - 1, 0)}"
        arcs[(here, ANY)] = [(after, None, ())]
        arcs[(here, TARGET)] = [(f"s{reach}", None, ())]
        arcs[(here, symbol)] = [(after, otherwise, cost), (f"w{reach}", out, ())]
        if left:
            arcs[(here, symbol)].append((after, out, ((kind, left / reach, 0.0),)))
    for left in range(1, reach + 1):
        here, after = f"w{left}", f"w{left - 1}"
        arcs[(here, ANY)] = [(after, None, ())] if left > 1 else []
        arcs[(here, symbol)] = [(after, otherwise, cost)] if left > 1 else []
        arcs[(here, TARGET)] = [(f"s{reach}", None, ((kind, left / reach, 0.0),))]
    return Transducer("s0", arcs, frozenset(f"w{left}" for left in range(1, reach + 1)))


def scope(opener: int, out: int, kind: str, despite: str, reach: int) -> Transducer:
    """Rewrites events within ``reach`` words after ``opener``, taking back what they weighed, or passes them on."""
    arcs: Arcs = {}
    for left in range(reach + 1):
        here, after = f"n{left}", f"n{max(left - 1, 0)}"
        arcs[(here, ANY)] = [(after, None, ())]
        arcs[(here, opener)] = [(f"n{reach}", None, ())]
        for event in EVENTS if left else ():
            back = ("menace", -1.0, 0.0) if event == MENACE else ("insult", 0.0, -1.0)
            arcs[(here, event)] = [(after, out, (back, (kind, 0.0, 1.0))), (after, None, ((despite, left / reach, 0.0),))]
    return Transducer("n0", arcs)


PARTS = (
    insults(),
    pointed(INSULT, ABUSE, "aimed", INSULT, (), reach=3),
    pointed(THREAT, MENACE, "menace", PLAIN, (("figurative", 1.0, 0.0),), reach=4),
    scope(NEGATION, DENIED, "denied", "despite denial", reach=3),
    scope(SAID, QUOTED, "quoted", "despite quotation", reach=12),
)
State = tuple[str, ...]


class Grammar:
    """The transducers composed: a state is one of each, found when a clause first gets there."""

    def __init__(self, weights: Sequence[float] | None = None, parts: tuple[Transducer, ...] = PARTS):
        self.parts = parts
        self.weights = dict(zip(KINDS, weights if weights is not None else PRIOR.values(), strict=True))
        self.start: State = tuple(part.start for part in parts)
        self.found: dict[tuple[State, int], list[tuple[State, int, float, float, tuple[Count, ...]]]] = {}

    def moves(self, state: State, symbol: int) -> list[tuple[State, int, float, float, tuple[Count, ...]]]:
        """Next state, symbol written, weight, weight for each unit of strength, and what counts."""
        if (state, symbol) not in self.found:
            runs: list[tuple[State, int, tuple[Count, ...]]] = [((), symbol, ())]
            for part, at in zip(self.parts, state, strict=True):
                runs = [
                    ((*nexts, after), given if out is None else out, counts + more)
                    for nexts, given, counts in runs
                    for after, out, more in part.moves(at, given)
                ]
            self.found[(state, symbol)] = [
                (after, out, sum(self.weights[k] * n for k, n, _ in counts), sum(self.weights[k] * n for k, _, n in counts), counts)
                for after, out, counts in runs
            ]
        return self.found[(state, symbol)]

    def ends(self, state: State) -> bool:
        return not any(at in part.waiting for part, at in zip(self.parts, state, strict=True))

    def read(self, symbols: Sequence[int], strengths: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
        """Weight of the best path of a clause, its counts in the order of ``KINDS`` and its marks in that of ``MARKS``.

        A mark counts its word's strength. Of paths of one weight, that found first is taken.
        """
        paths: dict[State, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol, strength in zip(symbols, strengths, strict=True):
            if symbol == PLAIN and len(paths) == 1 and self.start in paths:
                continue  # goes back to the same state and weighs nothing
            following: dict[State, tuple[float, tuple | None]] = {}
            for state, (total, trace) in paths.items():
                for after, out, weight, scaled, counts in self.moves(state, symbol):
                    value = total + weight + scaled * strength
                    if after not in following or following[after][0] < value:
                        told = (trace, out, strength, counts) if counts or out in MARK_OF else trace
                        following[after] = (value, told)
            paths = following
        best, trace = max((path for state, path in paths.items() if self.ends(state)), key=lambda path: path[0])
        counted, marks = np.zeros(len(KINDS)), np.zeros(len(MARKS))
        while trace is not None:
            trace, out, strength, counts = trace
            for kind, fixed, scaled in counts:
                counted[KINDS.index(kind)] += fixed + scaled * strength
            if out in MARK_OF:
                marks[MARK_OF[out]] += strength
        return best, counted, marks


def core(word: str) -> str:
    """A lower-case word without what stands around its letters."""
    return _EDGES.sub("", word)


def lexemes(text: str | None) -> set[str]:
    """The whole words of a text, and their proper beginnings with a star."""
    words = {core(word) for word in (text or "").lower().split()}
    found = set(words)
    for word in words:
        found.update(word[:k] + "*" for k in PREFIXES if k < len(word))
    found.discard("")
    return found


class Lexicon:
    """Class and weight of a word; what was looked up lately is kept."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.kept: dict[str, int] = {}
        self.entries: list[tuple[int, float, bool]] = []
        self.numbers: dict[tuple[int, float, bool], int] = {}
        self.hot = self.ends = np.zeros(0, dtype=bool)

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        """By entry number: whether it is an insult or threat, and whether it ends a clause."""
        if len(self.hot) != len(self.entries):
            self.hot = np.array([entry[0] in (INSULT, THREAT) for entry in self.entries])
            self.ends = np.array([entry[2] for entry in self.entries])
        return self.hot, self.ends

    def _entry(self, word: str) -> tuple[int, float, bool]:
        plain = core(word)
        keys = [plain, *(plain[:k] + "*" for k in PREFIXES if k < len(plain))]
        weight = max((self.insults[key] for key in keys if key in self.insults), default=0.0)
        ends = not ENDS.isdisjoint(word[-1:])
        if weight:
            return INSULT, weight, ends
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (SAID, SAYING)):
            if plain in words:
                return symbol, 1.0, ends
        return PLAIN, 0.0, ends

    def numbers_of(self, words: list[str]) -> np.ndarray:
        """A number for each word; equal numbers have equal entries."""
        kept = self.kept
        new = [word for word in set(words) if word not in kept]
        if len(kept) + len(new) > CACHED_WORDS:
            kept.clear()
            new = list(set(words))
        for word in new:
            entry = self._entry(word)
            if entry not in self.numbers:
                self.numbers[entry] = len(self.entries)
                self.entries.append(entry)
            kept[word] = self.numbers[entry]
        return np.fromiter(map(kept.__getitem__, words), dtype=np.int32, count=len(words))


def hot_clauses(text: str | None, lexicon: Lexicon) -> Iterator[tuple[list[int], list[float]]]:
    """Word classes and strengths of the clauses with an insult or a verb of harm; no other clause has a mark."""
    words = (text or "").lower().split()
    if not words:
        return
    numbers = lexicon.numbers_of(words)
    entries = lexicon.entries
    is_hot, ends = lexicon.flags()
    hot = is_hot[numbers]
    if not hot.any():
        return
    stops = np.flatnonzero(ends[numbers]) + 1
    bounds = np.unique(np.concatenate([[0], stops, [len(words)]]))
    for clause in np.unique(np.searchsorted(bounds, np.flatnonzero(hot), side="right") - 1):
        part = [entries[k] for k in numbers[bounds[clause] : bounds[clause + 1]].tolist()]
        yield [p[0] for p in part], [p[1] for p in part]


FEATURES = 2 * len(MARKS) + 3


def text_features(clauses: Iterable[tuple[Sequence[int], Sequence[float]]], machine: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Of the readings of all clauses: logarithms of the sums of each mark, the largest of each, the logarithm of the sum
    of their weights, the largest weight, and 0 or 1 for any mark; and the arcs of the weightiest reading."""
    out, arcs, heaviest = np.zeros(FEATURES), np.zeros(len(KINDS)), 0.0
    total, most = out[: len(MARKS)], out[len(MARKS) : 2 * len(MARKS)]
    for symbols, strengths in clauses:
        weight, counted, marks = machine.read(symbols, strengths)
        total += marks
        np.maximum(most, marks, out=most)
        out[-3] += max(weight, 0.0)
        if weight > heaviest:
            heaviest, arcs = weight, counted
    out[-1] = 1.0 if total.any() else 0.0
    total[:] = np.log1p(total)
    out[-3], out[-2] = np.log1p(out[-3]), heaviest
    return out, arcs


@dataclass
class Model:
    insults: dict[str, float]
    arcs: np.ndarray
    bias: float
    weights: np.ndarray

    def score(self, texts: Iterable[str | None], lexicon: Lexicon, machine: Grammar) -> np.ndarray:
        marks = np.array([text_features(hot_clauses(text, lexicon), machine)[0] for text in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(self.bias + marks @ self.weights, -30, 30)))


def fit_weights(
    marks: np.ndarray, labels: np.ndarray, penalty: float = 0.5, prior: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps with a quadratic penalty on what differs from ``prior`` (zero if not given)."""
    x = np.hstack([np.ones((len(marks), 1)), marks])
    center = np.concatenate([[0.0], np.zeros(marks.shape[1]) if prior is None else prior])
    w = center.copy()
    w[0] = -2.0
    ridge = np.diag([1e-3, *[penalty] * marks.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, x.T @ (p - labels) + ridge @ (w - center))
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return float(w[0]), w[1:]


def _count(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            halves = batch.column("half").to_pylist()
            for half, text in zip(halves, batch.column("text").to_pylist(), strict=True):
                found = lexemes(text)
                counts[half].update(found if only is None else found & only)
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([c[name] for name in names], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["lexeme", "n0", "n1"])

    return run


def _weigh(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lexemes far more frequent in toxic documents, with the logarithm of the ratio."""
    least = max(LEAST_DOCUMENTS, n_toxic // 200)
    weights = {
        name: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(name, 0) + 0.5) / (n_clean + 1)))
        for name, n in toxic.items()
        if n >= least
    }
    kept = sorted((-toxic[name] * weight, name) for name, weight in weights.items() if weight >= LEAST_WEIGHT)
    return {name: weights[name] for _, name in kept[:MOST_LEXEMES]}


def learn_insults(sample: DataFrame) -> list[dict[str, float]]:
    """Insults learned from half 0, from half 1 and from the whole ``sample`` (``half``, ``label``, ``text``).

    Candidates are counted in the toxic documents first, and only they in the others.
    """
    sizes = {(row.label, row.half): row["count"] for row in sample.groupBy("label", "half").count().collect()}

    def totals(label: int, only: frozenset[str] | None) -> DataFrame:
        docs = sample.filter(F.col("label") == label).select("half", "text")
        counted = docs.mapInArrow(tidy(_count(only)), "lexeme string, n0 long, n1 long")
        return counted.groupBy("lexeme").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    often = totals(1, None).withColumn("n", F.col("n0") + F.col("n1")).filter(F.col("n") >= LEAST_DOCUMENTS)
    toxic = often.orderBy(F.desc("n"), "lexeme").limit(MOST_CANDIDATES).collect()
    clean = totals(0, frozenset(row.lexeme for row in toxic)).collect()
    found = []
    for halves in ((0,), (1,), (0, 1)):
        counts = [{row.lexeme: sum(row[f"n{h}"] for h in halves) for row in rows} for rows in (toxic, clean)]
        found.append(_weigh(*counts, *(sum(sizes.get((label, h), 0) for h in halves) for label in (1, 0))))
    return found


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``most_rows`` labelled documents outside the held-out fold.

    Clauses are read on each half of the sample with the lexicon learned from the other half, so that the weights see a
    lexicon's errors on new documents; the lexicon that is used is learned from both. The weights of the arcs are learned
    in ``ROUNDS``: clauses are read by the present weights, then the arcs of each document's weightiest reading are fitted
    to the labels, held near ``PRIOR``. The marks are weighed last. Without toxic documents every score is low.
    """
    learn = fold("doc_id", FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, "toxic", learn, ["text"], most_rows)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = sample.select("label", half.alias("half"), "text")
    *of_half, insults = learn_insults(sample)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(found) for found in reversed(of_half)]
        for batch in batches:
            rows = zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True)
            clauses = [list(hot_clauses(text, lexicons[half])) for half, text in rows]
            symbols = pa.array([[bytes(c[0]) for c in doc] for doc in clauses], pa.list_(pa.binary()))
            strengths = pa.array([[c[1] for c in doc] for doc in clauses], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column("label"), symbols, strengths], ["label", "symbols", "strengths"])

    read = sample.mapInArrow(tidy(split), "label int, symbols array<binary>, strengths array<array<double>>")
    read = stage(read, "clauses")

    def features(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, features and arcs of the documents by the given weights of arcs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Grammar(weights.tolist())
            for batch in batches:
                rows = zip(batch.column("symbols").to_pylist(), batch.column("strengths").to_pylist(), strict=True)
                both = [np.concatenate(text_features(zip(*row, strict=True), machine)).tolist() for row in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(both, pa.list_(pa.float64()))], ["label", "marks"]
                )

        rows = read.mapInArrow(tidy(run), "label int, marks array<double>").groupBy("label", "marks").count()
        rows = rows.orderBy("label", "marks").collect()
        marks = np.array([row.marks for row in rows for _ in range(row["count"])]).reshape(-1, FEATURES + len(KINDS))
        known = np.array([row.label for row in rows for _ in range(row["count"])], dtype=float)
        return known, marks[:, :FEATURES], marks[:, FEATURES:]

    prior = np.array(list(PRIOR.values()))
    arcs = prior
    for _ in range(ROUNDS):
        known, _, counted = features(arcs)
        arcs = fit_weights(counted, known, ARC_PENALTY, prior)[1]
    known, marks, _ = features(arcs)
    return Model(insults, arcs, *fit_weights(marks, known))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row; a null text is scored as an empty one.

    Repeated rows are scored once each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(model.insults), Grammar(model.arcs.tolist())
        for whole in batches:
            for batch in slices(whole, "text"):
                values = model.score(batch.column("text").to_pylist(), lexicon, machine)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model fitted to ``labels``, with ``held_out`` for the fold not learned from."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
