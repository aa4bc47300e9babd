"""Log-likelihood of documents under a gated recurrent language model with a class-factored output.

The probability of the next word is that of its class times that of the word in its class. The most frequent words are
dealt into classes by frequency and have an output vector each. All other words, unseen ones included, fall into
classes by their last letters, in which a word has its smoothed share of the training tokens of its class; so the model
spreads exactly one over all words. The recurrent net is a gated unit trained by truncated back-propagation. It learns from
all training documents in each of ``EPOCHS`` rounds: learners of about ``LEARNER_TOKENS`` tokens start a round from one net, and
their nets are averaged by tokens. Every count is over all training documents too.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.llm.labelled import fold
from regiometric.llm.words import Words, WordTable, find_words, hash_words, mix, slices, text_bytes, tidy
from regiometric.session import stage

FOLDS, HELD_OUT = 7, 2
CLASS_WORDS, WORD_CLASSES = 64, 32
NEURAL = CLASS_WORDS * WORD_CLASSES - 1  # the end of a text is the last of the frequent words
SPELLINGS = 64
CLASSES = WORD_CLASSES + SPELLINGS
HIDDEN = 32
LISTED = 1 << 17
RANGES = 18
COUNTED = 1 << 20
LEARNER_TOKENS = 1 << 22
CHUNK_TOKENS = 1 << 18
SCORED_TOKENS = 1 << 22
AVERAGED = 4
EPOCHS = 1
STREAMS, WINDOW = 256, 32
LANES = 512
BLOCK = 1024
END = NEURAL
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Counts:
    """Training statistics. ``words``: hashes of the most frequent words, ascending, with their ``times`` and their
    ``rank``; ``rare_tokens``, ``rare_words``: totals by spelling of the words beyond the first ``NEURAL``."""

    words: np.ndarray
    times: np.ndarray
    rank: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @cached_property
    def ranges(self) -> np.ndarray:
        """The first word of each range of hashes that begin with the same ``RANGES`` bits."""
        begins = np.arange(1 << RANGES, dtype=np.uint64) << np.uint64(64 - RANGES)
        return np.searchsorted(self.words, begins)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among ``words`` and whether it is there."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = self.ranges[(hashes >> np.uint64(64 - RANGES)).view(np.int64)]
        at = np.minimum(at, len(self.words) - 1, out=at)
        going = np.flatnonzero(self.words[at] < hashes)
        while len(going):
            at[going] += 1
            going = going[at[going] < len(self.words) - 1]
            going = going[self.words[at[going]] < hashes[going]]
        at = np.minimum(at, len(self.words) - 1, out=at)
        return at, self.words[at] == hashes


def spellings(words: Words, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Class of each word, or of the chosen ones, by its last two letters and whether a sign follows them."""
    starts, last = words.starts[chosen], words.ends[chosen] - 1
    if not len(last):
        return np.zeros(0, dtype=np.int64)
    sign = ~_LETTERS[words.data[last]]
    a = np.maximum(last - sign, starts)
    b = np.maximum(a - 1, starts)
    code = words.data[a].astype(np.uint64) * np.uint64(512) + words.data[b] * np.uint64(2) + sign.astype(np.uint64)
    return (mix(code + np.uint64(1)) % np.uint64(SPELLINGS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of the batches with their times, given out whenever there are ``COUNTED`` of them."""
    table, spelling, times = WordTable(), [], np.zeros(0, dtype=np.int64)

    def counted() -> pa.RecordBatch:
        found = pa.array(table.left[: len(table)].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [found, pa.array(np.concatenate(spelling)), pa.array(times)], ["word", "spelling", "n"]
        )

    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            words = find_words(batch.column("text"), lower=True)
            hashes = hash_words(words)
            numbers, fresh = table.add(hashes, np.zeros_like(hashes))
            spelling.append(spellings(words, fresh))
            before, times = times, np.bincount(numbers, minlength=len(table))
            times[: len(before)] += before
            if len(table) >= COUNTED:
                yield counted()
                table, spelling, times = WordTable(), [], np.zeros(0, dtype=np.int64)
    if len(table):
        yield counted()


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (a 64-bit hash), ``spelling`` and ``n`` of every distinct word of ``docs``."""
    rows = docs.select("text").mapInArrow(tidy(_count, steady=True), "word long, spelling long, n long")
    return rows.groupBy("word").agg(F.min("spelling").alias("spelling"), F.sum("n").alias("n"))


def summarise(counts: DataFrame, texts: int) -> Counts:
    """Totals by spelling and the ``LISTED`` most frequent words, which are all that goes to the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(LISTED).select("word", "n").toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    times = top.column("n").to_numpy()
    rank = np.arange(len(words))
    order = np.argsort(words)
    totals = counts.groupBy("spelling").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()
    by_tokens, by_words = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for row in totals:
        by_tokens[row.spelling], by_words[row.spelling] = row.tokens, row.words
    tokens, distinct = int(by_tokens.sum()) + texts, int(by_words.sum()) + (texts > 0)
    neural = [int(w) for w in words[:NEURAL].view(np.int64)]
    for row in counts.filter(F.col("word").isin(neural)).groupBy("spelling").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")
    ).collect() if neural else []:
        by_tokens[row.spelling] -= row.tokens
        by_words[row.spelling] -= row.words
    return Counts(words[order], times[order], rank[order], by_tokens, by_words, tokens, distinct, texts)


@dataclass
class Net:
    """``embed``: input of the three gates by input id (frequent words, then spellings); ``u``: recurrent weights."""

    embed: np.ndarray
    u: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *[p.astype(np.float32) for p in self.parameters()])
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Net:
        held = np.load(io.BytesIO(raw))
        return cls(*[held[name] for name in held.files])


def new_net(counts: Counts, seed: int = 11) -> Net:
    """Small random weights; the output biases give every class and frequent word its training share."""
    rng = np.random.default_rng(seed)
    frequent = np.full(NEURAL + 1, 0.5)
    neural = counts.rank < NEURAL
    frequent[counts.rank[neural]] += counts.times[neural]
    frequent[END] += counts.texts
    grouped = frequent.reshape(WORD_CLASSES, CLASS_WORDS)
    shares = np.concatenate([grouped.sum(1), counts.rare_tokens + 0.5])

    def small(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.08, shape).astype(np.float32)

    return Net(
        small(NEURAL + 1 + SPELLINGS, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN) * 2,
        np.repeat(np.array([-1, 1, 0], dtype=np.float32), HIDDEN), small(HIDDEN, CLASSES),
        np.log(shares / shares.sum()).astype(np.float32), small(WORD_CLASSES, CLASS_WORDS, HIDDEN),
        np.log(grouped / grouped.sum(1, keepdims=True)).astype(np.float32),
    )


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights or inputs of the three gates, side by side in the last axis, as one block a gate."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).swapaxes(0, 1))


def _inputs(given: np.ndarray) -> np.ndarray:
    """Input and bias of the gates as blocks, those of the two logistic gates negated for ``_next_state``."""
    given = _by_gate(given)
    np.negative(given[:2], out=given[:2])
    return given


def _next_state(
    u: np.ndarray, given: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None, candidate: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``gated_step`` on blocks by gate; gates and candidate are written into the arrays that are passed for them."""
    gates = np.matmul(h, u[:2], out=gates)
    np.subtract(given[:2], gates, out=gates)
    np.exp(gates, out=gates)  # may be infinite, which gives 0
    gates += 1
    update, reset = np.reciprocal(gates, out=gates)
    candidate = np.matmul(reset * h, u[2], out=candidate)
    candidate += given[2]
    np.tanh(candidate, out=candidate)
    after = candidate - h
    after *= update
    after += h
    return after, gates, candidate


def gated_step(net: Net, given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state, the two gates one after the other and the candidate; ``given`` is input and bias of all three."""
    with np.errstate(over="ignore"):
        return _next_state(_by_gate(net.u), _inputs(given), h)


def _calm(weights: np.ndarray, bias: np.ndarray, inputs: int) -> bool:
    """Whether no state, whose parts lie between -1 and 1, can give a logit too large for ``exp``; then none is shifted."""
    return bool((np.abs(weights).sum(axis=inputs) + np.abs(bias)).max() < 60)


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], dtype=values.dtype)


def _column_sums(values: np.ndarray) -> np.ndarray:
    return np.ones(len(values), dtype=values.dtype) @ values


def _logits(states: np.ndarray, weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``states`` times ``weights``, written into the first numbers of ``room``."""
    out = room[: len(states) * weights.shape[1]].reshape(len(states), -1)
    return np.matmul(states, weights, out=out)


def _room() -> np.ndarray:
    """Room for the logits of ``BLOCK`` rows, which is used again from block to block."""
    return np.empty(BLOCK * max(CLASSES, CLASS_WORDS), dtype=np.float32)


def _slopes(logits: np.ndarray, picked: np.ndarray, scale: np.float32, calm: bool = False) -> np.ndarray:
    """``scale`` times the probabilities of each row, less one for the picked column, in place of the logits."""
    if not calm:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (scale / _row_sums(logits))[:, None]
    logits.reshape(-1)[_flat(logits, picked)] -= scale
    return logits


def _flat(values: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Place of the picked column of each row among all values."""
    return np.arange(0, values.size, values.shape[1]) + picked


def _log_share(logits: np.ndarray, bias: np.ndarray, picked: np.ndarray, calm: bool = False) -> np.ndarray:
    """Logarithm of the picked column's probability in each row of logits without bias, which are used up."""
    if not calm:
        logits += bias
        logits -= logits.max(axis=1, keepdims=True)
        bias = np.zeros_like(bias)
    own = logits.reshape(-1)[_flat(logits, picked)] + bias[picked]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.exp(bias))


def class_of(ids: np.ndarray) -> np.ndarray:
    """Output class of an input id."""
    every = np.arange(NEURAL + 1 + SPELLINGS)
    return np.where(every <= NEURAL, every // CLASS_WORDS, every - NEURAL - 1 + WORD_CLASSES)[ids]


def _order(ids: np.ndarray) -> np.ndarray:
    """Order of input ids, which are small enough to be sorted by their digits."""
    return np.argsort(ids.astype(np.int16), kind="stable")


def _blocks(begin: int, end: int) -> Iterator[slice]:
    """Ranges of at most ``BLOCK`` rows, whose logits stay in the processor's cache."""
    for at in range(begin, end, BLOCK):
        yield slice(at, min(at + BLOCK, end))


def calm_outputs(net: Net) -> tuple[bool, bool]:
    """Of the logits of classes, and of the words in them."""
    return _calm(net.to_class, net.class_bias, 0), _calm(net.to_word, net.word_bias, 2)


def log_probabilities(
    net: Net, states: np.ndarray, ids: np.ndarray, calm: tuple[bool, bool] | None = None
) -> np.ndarray:
    """Natural logarithm of the probability of each id given the state before it; of a rare word, of its class."""
    calm_class, calm_word = calm or calm_outputs(net)
    order = _order(ids)  # classes of frequent words are ranges of ids
    states, sorted_ids = states.take(order, axis=0), ids[order]
    kinds, values, room = class_of(sorted_ids), np.empty(len(ids)), _room()
    for at in _blocks(0, len(ids)):
        values[at] = _log_share(_logits(states[at], net.to_class, room), net.class_bias, kinds[at], calm_class)
    bounds = np.searchsorted(sorted_ids, np.arange(WORD_CLASSES + 1) * CLASS_WORDS)
    for k in np.flatnonzero(np.diff(bounds)):
        for at in _blocks(bounds[k], bounds[k + 1]):
            logits = _logits(states[at], net.to_word[k].T, room)
            values[at] += _log_share(logits, net.word_bias[k], sorted_ids[at] - k * CLASS_WORDS, calm_word)
    out = np.empty(len(ids))
    out[order] = values
    return out


def _window_gradients(net: Net, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients over one window (time by stream) from the state it begins with, and the state it ends with.

    ``fresh`` marks first words of texts, before which the state is zero.
    """
    steps, streams = ids.shape
    states, candidates = (np.empty((steps, streams, HIDDEN), dtype=np.float32) for _ in range(2))
    gates = np.empty((2, steps, streams, HIDDEN), dtype=np.float32)
    begins = fresh.any(axis=1)
    u, given = _by_gate(net.u), _inputs(net.embed + net.bias)
    for t in range(steps):
        states[t] = h
        if begins[t]:
            states[t, fresh[t]] = 0
        h = _next_state(u, given.take(ids[t], axis=1), states[t], gates[:, t], candidates[t])[0]
    flat_states, flat = states.reshape(-1, HIDDEN), ids.ravel()
    scale = np.float32(1 / flat.size)
    grads = [np.zeros_like(p) for p in net.parameters()]
    g_embed, g_u, g_bias, g_class, g_class_bias, g_word, g_word_bias = grads
    calm_class, calm_word = calm_outputs(net)
    # words of one class side by side, and within it by id, which serves the embeddings below as well
    order = _order(flat)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    sorted_states, sorted_ids = flat_states.take(order, axis=0), flat[order]
    kinds, sorted_back, room = class_of(sorted_ids), np.empty_like(sorted_states), _room()
    class_rows = np.ascontiguousarray(net.to_class.T)
    g_class_rows = np.zeros_like(class_rows)
    for at in _blocks(0, len(flat)):
        slope = _logits(sorted_states[at], net.to_class, room)
        slope += net.class_bias
        _slopes(slope, kinds[at], scale, calm_class)
        g_class_rows += slope.T @ sorted_states[at]
        g_class_bias += _column_sums(slope)
        np.matmul(slope, class_rows, out=sorted_back[at])
    g_class += g_class_rows.T
    bounds = np.searchsorted(sorted_ids, np.arange(WORD_CLASSES + 1) * CLASS_WORDS)
    for k in np.flatnonzero(np.diff(bounds)):
        for at in _blocks(bounds[k], bounds[k + 1]):
            slope = _logits(sorted_states[at], net.to_word[k].T, room)
            slope += net.word_bias[k]
            _slopes(slope, sorted_ids[at] - k * CLASS_WORDS, scale, calm_word)
            g_word[k] += slope.T @ sorted_states[at]
            g_word_bias[k] += _column_sums(slope)
            sorted_back[at] += slope @ net.to_word[k]
    back = sorted_back.take(place, axis=0).reshape(steps, streams, HIDDEN)
    carried = np.zeros_like(h)
    inputs = np.empty((3, steps, streams, HIDDEN), dtype=np.float32)
    back_u = np.ascontiguousarray(u.swapaxes(1, 2))
    for t in range(steps - 1, -1, -1):
        before, candidate, update, reset = states[t], candidates[t], gates[0, t], gates[1, t]
        d_update, d_reset, d_candidate = inputs[:, t]
        keep = 1 - update
        through = carried * update
        np.multiply(candidate, candidate, out=d_candidate)
        np.subtract(1, d_candidate, out=d_candidate)
        d_candidate *= through
        np.subtract(candidate, before, out=d_update)
        d_update *= through
        d_update *= keep
        d_mixed = d_candidate @ back_u[2]
        d_mixed *= reset
        np.subtract(1, reset, out=d_reset)
        d_reset *= before
        d_reset *= d_mixed
        carried *= keep
        carried += d_mixed
        carried += d_update @ back_u[0]
        carried += d_reset @ back_u[1]
        carried += back[t]
        if begins[t]:
            carried[fresh[t]] = 0
    first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    used = sorted_ids[first]
    for gate, rows in enumerate(inputs.reshape(3, -1, HIDDEN)):
        part = slice(gate * HIDDEN, (gate + 1) * HIDDEN)
        for at in _blocks(0, len(flat)):
            before = flat_states[at]
            g_u[:, part] += (rows[at].T @ (gates[1].reshape(-1, HIDDEN)[at] * before if gate == 2 else before)).T
        # two numbers as one complex number, which halves the sums
        sums = np.add.reduceat(rows.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        g_embed[used, part] = sums
        g_bias[part] = _column_sums(sums)
    return grads, h


class Learner:
    """Adam over windows of ``WINDOW`` words of up to ``STREAMS`` parallel streams.

    ``begun`` and ``expected``: words learned from in earlier rounds and in all rounds, by which the rate falls.
    """

    def __init__(self, net: Net, begun: int, expected: int):
        self.net, self.done, self.expected, self.step = net, begun, max(expected, 1), 0
        self.first = [np.zeros_like(p) for p in net.parameters()]
        self.second = [np.zeros_like(p) for p in net.parameters()]

    def learn(self, ids: np.ndarray, fresh: np.ndarray) -> None:
        """Every word of ``ids`` once; states go on from window to window. Streams differ by one word at most."""
        streams = min(STREAMS, max(1, len(ids) // WINDOW))
        length, longer = divmod(len(ids), streams)
        begin = np.arange(streams) * length + np.minimum(np.arange(streams), longer)
        h = np.zeros((streams, HIDDEN), dtype=np.float32)
        for at in range(0, length, WINDOW):
            place = begin[None] + np.arange(at, min(at + WINDOW, length))[:, None]
            h = self._window(ids[place], fresh[place], h)
        if longer:
            place = begin[None, :longer] + length
            self._window(ids[place], fresh[place], h[:longer])

    def _window(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            grads, h = _window_gradients(self.net, ids, fresh, h)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        self.step += 1
        self.done += ids.size
        step = self.step
        rate = 0.01 * (1 - 0.9 * min(1.0, self.done / self.expected)) * min(1.0, step / 20)
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        # sqrt(b / (1 - 0.99**step)) + 1e-8, with the root of the divisor taken out
        spread = (1 - 0.99**step) ** 0.5
        length, least = np.float32(rate * spread / (1 - 0.9**step)), np.float32(1e-8 * spread)
        for whole in zip(self.net.parameters(), grads, self.first, self.second, strict=True):
            for p, g, a, b in self._parts(*whole):
                g *= np.float32(0.1) * clip
                a *= np.float32(0.9)
                a += g
                g *= g  # a hundredth of the square
                b *= np.float32(0.99)
                b += g
                np.sqrt(b, out=g)
                g += least
                np.divide(a, g, out=g)
                g *= length
                p -= g
        return h

    @staticmethod
    def _parts(*arrays: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The arrays' numbers in parts that stay in the processor's cache, as views."""
        flat = [x.reshape(-1) for x in arrays]
        for at in range(0, len(flat[0]), 1 << 14):
            yield [x[at : at + (1 << 14)] for x in flat]


def train(net: Net, ids: np.ndarray, fresh: np.ndarray, epochs: int = EPOCHS) -> Net:
    """One learner over all of ``ids``, ``epochs`` times."""
    learner = Learner(net, 0, epochs * len(ids))
    for _ in range(epochs):
        learner.learn(ids, fresh)
    return net


def token_ids(words: Words, hashes: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input id of each word, its place in the list of frequent words and whether it is there."""
    at, listed = counts.find(hashes)
    ids = np.where(listed, counts.rank[at], NEURAL) if len(counts.rank) else np.full(len(at), NEURAL)
    rare = np.flatnonzero(ids >= NEURAL)
    ids[rare] = NEURAL + 1 + spellings(words, rare)
    return ids, at, listed


def _with_ends(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.insert(ids, first[1:], END)


def neural_scores(net: Net, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each text, whose ids stand one after the other.

    Texts of like length run side by side; each carries its state from window to window to its end.
    """
    out = np.zeros(len(lengths))
    begin = np.cumsum(lengths) - lengths
    u, inputs, calm = _by_gate(net.u), _inputs(net.embed + net.bias), calm_outputs(net)
    longest_first = np.argsort(-lengths, kind="stable")
    for at in range(0, len(lengths), LANES):
        rows = longest_first[at : at + LANES]
        sizes, starts = lengths[rows], begin[rows]
        h = np.zeros((len(rows), HIDDEN), dtype=np.float32)
        most = int(sizes[0])
        going = np.searchsorted(-sizes, -np.arange(most), side="left")  # texts longer than each step
        for window in range(0, most, WINDOW):
            states, seen, lanes = [], [], []
            for t in range(window, min(window + WINDOW, most)):
                n = int(going[t])
                h = h[:n]
                now = ids[starts[:n] + t]
                states.append(h)
                seen.append(now)
                lanes.append(n)
                with np.errstate(over="ignore"):
                    h = _next_state(u, inputs.take(now, axis=1), h)[0]
            values = log_probabilities(net, np.concatenate(states), np.concatenate(seen), calm)
            lane = np.concatenate([np.arange(n) for n in lanes])
            out[rows] += np.bincount(lane, values, minlength=len(rows))
    return out


def _average(group: pa.Table) -> pa.Table:
    """Mean of the nets of one group by tokens."""
    sums, total = None, 0
    for raw, tokens in zip(group.column("net"), group.column("tokens").to_pylist(), strict=True):
        parts = [p.astype(np.float64) * tokens for p in Net.load(raw.as_py()).parameters()]
        sums = parts if sums is None else [x + y for x, y in zip(sums, parts, strict=True)]
        total += tokens
    net = Net(*[x / total for x in sums])
    return pa.table({
        "number": group.column("number").slice(0, 1), "net": pa.array([net.dump()], pa.binary()), "tokens": pa.array([total])
    })


def average(nets: DataFrame) -> Net:
    """Mean of all ``net`` by ``tokens``, through a tree whose every node takes ``AVERAGED`` neighbours by ``number``."""
    left = nets.agg(F.max("number")).first()[0] + 1
    while left > 1:
        left = -(-left // AVERAGED)
        grouped = nets.withColumn("number", F.floor(F.col("number") / AVERAGED).cast("int")).repartition(left, "number")
        nets = grouped.groupBy("number").applyInArrow(_average, "number int, net binary, tokens long")
    return Net.load(nets.select("net").collect()[0].net)


def _pack(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Input ids of texts as one run of bytes each, which Spark copies as a whole; ``ends``: n + 1 offsets of the texts."""
    offsets = (ends * 2).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<i2"))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of all texts one after the other, and how many each has."""
    data, offsets = text_bytes(column)
    return data.view("<i2"), np.diff(offsets) // 2


def encode(docs: DataFrame, counts: Counts, id_column: str = "doc_id", packed: bool = False) -> DataFrame:
    """Every row as what learning and scoring need of it; texts are split into words here and not again.

    ``id``, ``held_out``, ``ids`` (input ids of the words and the end), ``known`` (words in the list of frequent ones),
    ``logs`` (base 10 logarithms of their counts plus one, added up), ``inside`` (shares of rare words in their classes,
    without the counts of unlisted words), ``unlisted`` (the other words with their times), ``row`` and ``mark`` (a hash
    that deals and orders the rows). With ``packed`` the ids are bytes, two for each, as learning and scoring read them.
    """
    rest, log_times = np.log10(counts.rare_tokens + counts.rare_words + 1), np.log10(counts.times + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words, n = find_words(batch.column("text"), lower=True), batch.num_rows
                hashes = hash_words(words)
                found, at, listed = token_ids(words, hashes, counts)
                text = words.text_of()
                logs = np.zeros(len(found))
                if len(log_times):
                    logs[listed] = log_times[at[listed]]
                rare, inside = np.flatnonzero(found > NEURAL), np.zeros(len(found))
                inside[rare] = logs[rare] - rest[found[rare] - NEURAL - 1]  # of unlisted words the logarithm is 0 here
                values, back = np.unique(hashes[~listed], return_inverse=True)
                codes, times = np.unique(text[~listed] * max(len(values), 1) + back, return_counts=True)
                owner = codes // max(len(values), 1)
                words_of = values[codes - owner * max(len(values), 1)] if len(values) else values
                cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                unlisted = pa.StructArray.from_arrays(
                    [pa.array(words_of.view(np.int64)), pa.array(times.astype(np.int32))], ["word", "n"]
                )
                ends = (words.first + np.arange(n + 1)).astype(np.int32)
                ids = _with_ends(found, words.first).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        _pack(ids, ends) if packed else pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                        pa.array(np.bincount(text[listed], minlength=n)),
                        pa.array(np.bincount(text, logs, minlength=n).astype(float)),
                        pa.array(np.bincount(text, inside, minlength=n).astype(float)),
                        pa.ListArray.from_arrays(pa.array(cuts), unlisted),
                    ],
                    ["id", "ids", "known", "logs", "inside", "unlisted"],
                )

    source = docs.select(F.col(id_column).alias("id"), F.col("text").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    parts = f"ids {'binary' if packed else 'array<short>'}, known long, logs double, inside double"
    parts += ", unlisted array<struct<word:long,n:int>>"
    coded = source.mapInArrow(tidy(run, steady=True), f"id {kind}, {parts}").withColumn("row", F.monotonically_increasing_id())
    size = (F.octet_length("ids") / 2).cast("int") if packed else F.size("ids")
    return coded.withColumns({"held_out": fold("id", FOLDS) == HELD_OUT, "mark": F.xxhash64("row", size)})


def fit(docs: DataFrame, counts: Counts) -> Net:
    """A net that has learned from every row of ``docs``, ``EPOCHS`` times."""
    return learn_from(stage(encode(docs, counts, packed=True), "coded"), counts)


def learn_from(coded: DataFrame, counts: Counts) -> Net:
    """A net that has learned from every row of ``coded``, a written result of ``encode`` (packed), ``EPOCHS`` times.

    Rows are dealt to learners by a hash. Each round every learner goes on from the mean of the last round's nets, which
    is made by a tree of averages; one net a round goes to the driver and back to the tasks.
    """
    learners = max(1, -(-counts.tokens // LEARNER_TOKENS))
    each = -(-counts.tokens // learners)
    net = new_net(counts)
    for number in range(EPOCHS if counts.tokens else 0):
        given = net.dump()

        def run(
            batches: Iterator[pa.RecordBatch], given: bytes = given, number: int = number
        ) -> Iterator[pa.RecordBatch]:
            learner = Learner(Net.load(given), number * each, EPOCHS * each)
            held, have, total = [], 0, 0

            def learn() -> None:
                sizes = np.concatenate([sizes for _, sizes in held])
                ids = np.concatenate([ids for ids, _ in held]).astype(np.int64)
                fresh = np.zeros(len(ids), dtype=bool)
                fresh[np.cumsum(sizes) - sizes] = True
                learner.learn(ids, fresh)

            for whole in batches:
                lists = whole.column("ids")
                for at in range(0, len(lists), 64):
                    part = _unpack(lists.slice(at, 64))
                    held.append(part)
                    have += len(part[0])
                    if have >= CHUNK_TOKENS:
                        learn()
                        held, have, total = [], 0, total + have
            if have:
                learn()
                total += have
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([learner.net.dump()], pa.binary()), pa.array([total])], ["net", "tokens"]
                )

        dealt = coded.repartition(learners, "mark").sortWithinPartitions("mark").select("ids")
        nets = dealt.mapInArrow(tidy(run, steady=True), "net binary, tokens long").withColumn("number", F.spark_partition_id())
        net = average(stage(nets, "nets"))
    return net


def score(coded: DataFrame, counted: DataFrame, counts: Counts, net: Net, id_column: str = "doc_id") -> DataFrame:
    """One row for each of ``coded``, a written result of ``encode`` (packed), with both scores; see ``score_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids, sizes = _unpack(whole.column("ids"))
            ends = np.cumsum(sizes)
            part_of = (ends - sizes) // SCORED_TOKENS
            starts = np.flatnonzero(np.diff(part_of, prepend=-1))
            for begin, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
                batch, lengths = whole.slice(begin, end - begin), sizes[begin:end]
                given = ids[ends[begin] - sizes[begin] : ends[end - 1]].astype(np.int64)
                neural = neural_scores(net, given, lengths)
                neural = neural / np.log(10) + batch.column("inside").to_numpy()
                kept = [batch.column(name) for name in ("id", "held_out", "row", "known", "logs")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lengths), pa.array(neural)],
                    ["id", "held_out", "row", "known", "logs", "n_tokens", "neural"],
                )

    kind = coded.schema["id"].dataType.simpleString()
    scored = coded.select("id", "held_out", "row", "known", "logs", "inside", "ids").mapInArrow(
        tidy(run, steady=True), f"id {kind}, held_out boolean, row long, known long, logs double, n_tokens long, neural double"
    )
    words = coded.select("row", F.explode("unlisted").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    found = words.join(counted.select("word", "n"), "word")
    more = found.groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs")
    )
    zero = F.lit(0.0)
    more_logs = F.coalesce("more_logs", zero)
    end_log, spread = float(np.log10(counts.texts + 1)), float(np.log10(counts.tokens + counts.distinct + 1))
    return scored.join(more, "row", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(counts.texts > 0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs + F.lit(end_log) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("neural") + more_logs).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Training documents are those whose id's CRC-32 modulo ``FOLDS`` is not ``HELD_OUT``. Each text ends in one end token. A
    null text is empty and has that token only. Repeated rows are learned from and scored once each. A null id counts as the
    empty text for the fold. Other columns are ignored. Without training documents all words are unseen.
    """
    whole = docs.select("doc_id", "text")
    training = whole.filter(fold("doc_id", FOLDS) != HELD_OUT)
    counted = stage(count_words(training), "counts")
    counts = summarise(counted, training.select("doc_id").count())
    coded = stage(encode(whole, counts, packed=True), "coded")
    return score(coded, counted, counts, learn_from(coded.filter(~F.col("held_out")), counts))
