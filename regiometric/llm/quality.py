"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is ``b + sum(w * x) + sum over pairs(<v_i, v_j> * x_i * x_j)``; the pair term is computed in
linear time as half the square of the sum less the sum of the squares, per factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.llm.labelled import SAMPLE_ROWS, fold, labelled_sample
from regiometric.llm.words import Runs, find_words, hash_words, slices, tidy

BINS = 1 << 13
FACTORS = 8
LEVELS = 10
THRESHOLD = 0.3
FOLDS = 5
EPOCHS = 12
STATISTICS = (
    "upper", "digits", "symbols", "high_bytes", "white", "lines", "word_length", "symbol_ends", "distinct_words",
    "same_as_before", "distinct_triples", "without_letters", "words", "top_word", "n_chars",
)
_CHARS = np.zeros((6, 256), dtype=np.int32)
_CHARS[0, 65:91] = 1
_CHARS[1, 48:58] = 1
_CHARS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CHARS[2, [ord(c) for c in ".,'-"]] = 0
_CHARS[3, 128:] = 1
_CHARS[4, [9, 11, 12, 13, 32]] = 1
_CHARS[5, 10] = 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between each two offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(group: np.ndarray, values: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each group, and how often its most frequent one occurs."""
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(groups)
    np.maximum.at(most, group[first], np.diff(first, append=len(group)))
    return np.bincount(group[first], minlength=groups).astype(float), most


@dataclass
class Features:
    """``stats``: a row per text. Hashed words: bins ``bin`` with values ``value``, those of text d at
    ``first[d]:first[d + 1]``."""

    stats: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    first: np.ndarray


def features(texts: pa.Array, n_chars: pa.Array) -> Features:
    """Features of whole texts; a null or blank text has zero statistics and no words, a null ``n_chars`` is 0."""
    words = find_words(texts)
    n = len(texts)
    size = np.maximum(np.diff(words.offsets), 1)
    count = np.diff(words.first)
    least = np.maximum(count, 1)
    hashes = hash_words(words)
    text = words.text_of()
    stats = np.zeros((n, len(STATISTICS)))
    for k in range(6):
        stats[:, k] = _sums(_CHARS[k][words.data], words.offsets) / size
    stats[:, 6] = np.log1p(_sums(words.ends - words.starts, words.first) / least)
    last = words.data[words.ends - 1] if len(words.ends) else np.zeros(0, dtype=np.uint8)
    stats[:, 7] = _sums(_CHARS[2][last], words.first) / least
    distinct, most = _distinct(text, hashes, n)
    stats[:, 8] = distinct / least
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    stats[:, 9] = _sums(same, words.first) / least
    at = np.flatnonzero(np.arange(len(hashes)) + 3 <= words.first[text + 1])
    triples, _ = _distinct(text[at], Runs.of(hashes).hash(at, 3), n)
    stats[:, 10] = triples / np.maximum(count - 2, 1)
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.data])])
    stats[:, 11] = _sums(letters[words.ends] == letters[words.starts], words.first) / least
    stats[:, 12] = np.log1p(count)
    stats[:, 13] = most / least
    told = n_chars.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    stats[:, 14] = np.log1p(np.maximum(np.nan_to_num(told), 0))

    codes, times = np.unique(text * BINS + (hashes % np.uint64(BINS)).astype(np.int64), return_counts=True)
    row = codes // BINS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    return Features(stats, (codes % BINS), value / norm[row], np.searchsorted(row, np.arange(n + 1)))


@dataclass
class Machine:
    """A fitted machine. ``edges``: LEVELS - 1 cut points of each statistic."""

    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def columns(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of every non-zero input: hashed words, then one level of each statistic."""
        n, width = f.stats.shape
        level = (f.stats[:, :, None] > self.edges[None]).sum(axis=2)
        place = BINS + np.arange(width) * LEVELS + level
        row = np.concatenate([np.repeat(np.arange(n), np.diff(f.first)), np.repeat(np.arange(n), width)])
        column = np.concatenate([f.bin, place.ravel()]).astype(np.int64)
        value = np.concatenate([f.value, np.full(n * width, 1 / np.sqrt(width))])
        return row, column, value

    def logits(self, f: Features) -> np.ndarray:
        row, column, value = self.columns(f)
        n = len(f.stats)
        out = self.bias + np.bincount(row, self.w[column] * value, minlength=n)
        for k in range(self.v.shape[1]):
            part = self.v[column, k] * value
            out += 0.5 * (np.bincount(row, part, minlength=n) ** 2 - np.bincount(row, part**2, minlength=n))
        return out


def fit_machine(f: Features, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, minimised by Adam over shuffled batches; deterministic."""
    levels = np.linspace(0, 1, LEVELS + 1)[1:-1]
    edges = np.quantile(f.stats, levels, axis=0).T if len(f.stats) else np.zeros((len(STATISTICS), LEVELS - 1))
    rng = np.random.default_rng(seed)
    size = BINS + len(STATISTICS) * LEVELS
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not len(labels):
        return m
    row, column, value = m.columns(f)
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(len(labels) + 1))
    moments = [np.zeros(size), np.zeros(size), np.zeros((size, FACTORS)), np.zeros((size, FACTORS))]
    step = 0
    for epoch in range(epochs):
        rate = 0.03 * (1 - epoch / epochs)
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), 256):
            rows = shuffled[at : at + 256]
            spans = first[rows + 1] - first[rows]
            index = np.repeat(first[rows] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
            local = np.repeat(np.arange(len(rows)), spans)
            c, x = column[index], value[index]
            vx = m.v[c] * x[:, None]
            total = np.stack([np.bincount(local, vx[:, k], minlength=len(rows)) for k in range(FACTORS)], axis=1)
            square = np.bincount(local, (vx**2).sum(axis=1), minlength=len(rows))
            logit = m.bias + np.bincount(local, m.w[c] * x, minlength=len(rows)) + 0.5 * ((total**2).sum(1) - square)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)
            used, back = np.unique(c, return_inverse=True)
            pull = slope[local] * x
            grad_w = np.bincount(back, pull, minlength=len(used)) + 1e-5 * m.w[used]
            each = pull[:, None] * (total[local] - vx)
            grad_v = np.stack([np.bincount(back, each[:, k], minlength=len(used)) for k in range(FACTORS)], axis=1)
            grad_v += 1e-4 * m.v[used]
            step += 1
            for target, grad, a, b in ((m.w, grad_w, 0, 1), (m.v, grad_v, 2, 3)):
                moments[a][used] = 0.9 * moments[a][used] + 0.1 * grad
                moments[b][used] = 0.99 * moments[b][used] + 0.01 * grad**2
                mean, spread = moments[a][used] / (1 - 0.9**step), moments[b][used] / (1 - 0.99**step)
                target[used] -= rate * mean / (np.sqrt(spread) + 1e-8)
            m.bias -= rate * float(slope.sum())
    return m


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            f = features(batch.column("text"), batch.column("n_chars"))
            cuts = pa.array(f.first.astype(np.int32))
            wide = pa.array(np.arange(0, f.stats.size + 1, f.stats.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(wide, pa.array(f.stats.ravel())),
                    pa.ListArray.from_arrays(cuts, pa.array(f.bin.astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(f.value.astype(np.float32))),
                ],
                ["doc_id", "label", "stats", "bin", "value"],
            )


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given = [batch for batch in batches if batch.num_rows]
    if not given:
        return
    rows = pa.Table.from_batches(given).sort_by("doc_id").combine_chunks()
    stats = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    counts = rows.column("bin").combine_chunks().value_lengths().to_numpy()
    f = Features(
        stats,
        rows.column("bin").combine_chunks().flatten().to_numpy().astype(np.int64),
        rows.column("value").combine_chunks().flatten().to_numpy().astype(np.float64),
        np.concatenate([[0], np.cumsum(counts)]),
    )
    m = fit_machine(f, rows.column("label").to_numpy().astype(float))
    parts = [m.edges.ravel(), np.array([m.bias]), m.w, m.v.ravel()]
    flat = np.concatenate(parts)
    yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted in one task to at most ``most_rows`` labelled documents outside the held-out fold."""
    learn = fold("doc_id", FOLDS) != 0
    sample = labelled_sample(docs, labels, "quality", learn, ["text", "n_chars"], most_rows)
    schema = "doc_id long, label int, stats array<double>, bin array<int>, value array<float>"
    source = sample.select(F.col("doc_id").cast("long"), "label", "text", "n_chars")
    rows = source.mapInArrow(tidy(_feature_rows), schema).repartition(1)
    found = rows.mapInArrow(tidy(_fit_task), "weights array<double>").collect()
    if not found:
        none = Features(np.zeros((0, len(STATISTICS))), *(np.zeros(0, dtype=np.int64),) * 2, np.zeros(1, dtype=np.int64))
        return fit_machine(none, np.zeros(0))
    flat = np.array(found[0]["weights"])
    size, cut = BINS + len(STATISTICS) * LEVELS, len(STATISTICS) * (LEVELS - 1)
    edges, bias, rest = flat[:cut].reshape(len(STATISTICS), -1), float(flat[cut]), flat[cut + 1 :]
    return Machine(edges, bias, rest[:size], rest[size:].reshape(size, FACTORS))


def score(docs: DataFrame, machine: Machine, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns in ``carry``, ``score`` in 0 to 1 and ``predicted`` (1 from ``THRESHOLD`` up).

    A null text is scored as an empty one; repeated rows are scored once each; other columns are ignored.
    """
    carried = list(dict.fromkeys(["doc_id", *(carry or [])]))
    row = F.struct(*[F.col(name).alias(f"f{i}") for i, name in enumerate(carried)]).alias("row")
    source = docs.select(row, F.col("text").alias("text"), F.col("n_chars").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                logit = machine.logits(features(batch.column("text"), batch.column("n_chars")))
                value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(value)], ["row", "score"])

    done = source.mapInArrow(tidy(run), f"row {source.schema['row'].dataType.simpleString()}, score double")
    fields = [F.col("row")[f"f{i}"].alias(name) for i, name in enumerate(carried)]
    return done.select(*fields, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Scores of all documents by a machine fitted to ``labels``, with ``held_out`` for the fold not learned from."""
    scored = score(docs, fit(docs, labels), carry)
    rest = [name for name in scored.columns if name != "doc_id"]
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), *rest)
