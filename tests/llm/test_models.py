import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regiometric.llm import language_model as lm
from regiometric.llm import quality, toxicity

from .conftest import SCHEMA, prose, row


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with and without marks of low quality and insults, and their labels with odd rows among them."""
    docs, labels = [], []
    for k in range(400):
        text = prose(1000 + k, 60)
        bad, toxic = k % 5 == 0, k % 4 == 0
        if bad:
            text = " ".join(word + "###" for word in text.split())
        if toxic:
            words = text.split()
            words[10] = words[30] = ("gromf" if k % 8 else "Zulk") + words[10].strip(".,").lower()
            text = " ".join(words)
        docs.append(row(k, text))
        labels.append((k, int(not bad), int(toxic), "x"))
    labels += [(None, 1, 1, "x"), (3, None, None, "x"), (10_000, 1, 0, "x"), (7, 1, 0, "x")]
    docs += [row(500, None), row(501, ""), row(None, "a b"), row(502, prose(9, 20_000)), row(3, prose(1003, 60))]
    schema = "doc_id long, quality int, toxic int, text string"
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, schema)


def check_scores(rows, docs, labels, label, folds, held, cut):
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs)
    wanted = {r.doc_id: r[label] for r in labels if r[label] is not None}
    for r in rows:
        given = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(given.encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    new = [(r.predicted, wanted[r.doc_id]) for r in rows if r.held_out and r.doc_id in wanted]
    assert sum(a == b for a, b in new) / len(new) > 0.9


def test_quality(labelled):
    docs, labels = labelled
    rows = quality.classify(docs, labels, carry=["row", "text"]).collect()
    check_scores(rows, docs.collect(), labels.collect(), "quality", 5, 0, 0.3)
    assert {r.row for r in rows} == {"r"}


def test_pair_terms_equal_the_double_sum():
    rng = np.random.default_rng(0)
    size = quality.BINS + len(quality.STATISTICS) * quality.LEVELS
    edges = np.zeros((len(quality.STATISTICS), quality.LEVELS - 1))
    m = quality.Machine(edges, 0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)))
    stats = rng.normal(size=(2, len(quality.STATISTICS)))
    f = quality.Features(stats, np.array([1, 5, 9, 5]), np.array([0.5, 0.2, 0.8, 1.0]), np.array([0, 3, 4]))
    row_of, column, value = m.columns(f)
    for text in (0, 1):
        at = np.flatnonzero(row_of == text)
        c, x = column[at], value[at]
        total = 0.3 + (m.w[c] * x).sum()
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                total += m.v[c[i]] @ m.v[c[j]] * x[i] * x[j]
        assert m.logits(f)[text] == pytest.approx(total)


def test_toxicity(labelled):
    docs, labels = labelled
    rows = toxicity.classify(docs, labels).collect()
    check_scores(rows, docs.collect(), labels.collect(), "toxic", 3, 1, 0.7)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify, lambda docs, _: lm.score_documents(docs)])
def test_models_of_nothing(spark, no_docs, odd_docs, classify):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(no_docs, labels).collect() == []
    assert len(classify(odd_docs, labels).collect()) == odd_docs.count()


P, I, T, G, N, R = range(6)


def readings(part, tape):
    """Every tape that a transducer writes for a tape, with what counts on the way, by trying all arcs."""
    found = []

    def go(state, at, out, counts):
        if at == len(tape):
            if state not in part.waiting:
                found.append((tuple(out), counts))
            return
        for after, wrote, more in part.moves(state, tape[at]):
            told = [(kind, at, fixed, scaled) for kind, fixed, scaled in more]
            go(after, at + 1, [*out, tape[at] if wrote is None else wrote], counts + told)

    go(part.start, 0, [], [])
    return found


@settings(deadline=None, max_examples=150)
@given(
    st.lists(st.tuples(st.sampled_from([P, P, I, I, T, G, N, R]), st.sampled_from([1.0, 2.5, 4.0])), max_size=7),
    st.integers(0, 1000),
)
def test_best_path_against_all_paths(clause, seed):
    """The reading is the best of all that the transducers give one after the other, for any weights of the arcs."""
    symbols, strengths = [c for c, _ in clause], [s for _, s in clause]
    prior = np.array(list(toxicity.PRIOR.values()))
    weights = prior if seed % 3 == 0 else prior + np.random.default_rng(seed).normal(size=len(prior))
    tapes = [(tuple(symbols), [])]
    for part in toxicity.PARTS:
        tapes = [(out, counts + more) for tape, counts in tapes for out, more in readings(part, tape)]
    of_kind = dict(zip(toxicity.KINDS, weights.tolist(), strict=True))
    totals = [sum(of_kind[k] * (f + s * strengths[at]) for k, at, f, s in counts) for _, counts in tapes]
    weight, counted, marks = toxicity.Grammar(weights.tolist()).read(symbols, strengths)
    assert weight == pytest.approx(max(totals)) == pytest.approx(float(counted @ weights))
    best = [tape for (tape, _), total in zip(tapes, totals, strict=True) if total > max(totals) - 1e-9]
    told = [[sum(s for x, s in zip(tape, strengths, strict=True) if toxicity.MARK_OF.get(x) == m) for m in range(5)] for tape in best]
    assert any(marks.tolist() == pytest.approx(one) for one in told)


def test_grammar():
    machine = toxicity.Grammar()

    def marks(*symbols, strength=3.0):
        read = machine.read(symbols, [strength if s == I else 1.0 for s in symbols])
        return {name: n for name, n in zip(toxicity.MARKS, read[2].tolist(), strict=True) if n}

    assert marks() == marks(P, P) == marks(N, R, G) == {}
    assert marks(P, I) == {"insult": 3} and marks(G, P, I) == marks(I, P, G) == {"abuse": 3}
    assert marks(G, P, P, P, I) == {"insult": 3} and marks(I, strength=0.5) == {}
    assert marks(T, G) == marks(G, T) == {"menace": 1} and marks(T, P) == marks(T) == marks(T, P, P, P, P, G) == {}
    # near a negation a word is denied; a strong word outweighs a negation further off
    assert marks(N, I) == {"denied": 3} and marks(N, P, P, I) == {"insult": 3} and marks(N, P, P, P, I) == {"insult": 3}
    assert marks(R, P, I) == {"quoted": 3} and marks(I, R) == {"insult": 3} and marks(N, T, G) == {"denied": 1}
    assert machine.read([N, I], [1, 3])[0] < machine.read([P, I], [1, 3])[0] < machine.read([G, I], [1, 3])[0]


def test_arcs_are_learned():
    """Denied words in toxic documents raise the weight of their arc, such words in others lower it."""
    prior = np.array(list(toxicity.PRIOR.values()))
    at = toxicity.KINDS.index("denied")
    counted = np.array([toxicity.Grammar().read([N, I], [1.0, 3.0])[1]] * 100 + [np.zeros(len(prior))] * 100)
    up = toxicity.fit_weights(counted, np.repeat([1.0, 0.0], 100), 1.0, prior)[1]
    down = toxicity.fit_weights(counted, np.repeat([0.0, 1.0], 100), 1.0, prior)[1]
    assert up[at] > prior[at] > down[at]


def test_language_model(spark, odd_docs):
    rows = lm.score_documents(odd_docs).collect()
    given = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in odd_docs.collect()]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = Counter(w for doc_id, words in given if not held(doc_id) for w in words)
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for doc_id, words in given:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        wanted[(doc_id, held(doc_id), len(words), sum(counts[w] > 0 for w in words), n, round(base, 5))] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    assert got == wanted
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def some_counts():
    words = np.sort(lm.mix(np.arange(1, 3000, dtype=np.uint64)))
    times = np.random.default_rng(5).integers(1, 50, len(words))
    rank = np.argsort(np.argsort(-times, kind="stable"))
    spread = np.full(lm.SPELLINGS, 7.0)
    return lm.Counts(words, times, rank, spread, spread, int(times.sum()), len(words), 20)


def test_probabilities_add_up_to_one():
    net = lm.new_net(some_counts())
    state = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    ids = np.arange(lm.NEURAL + 1 + lm.SPELLINGS)
    logs = lm.log_probabilities(net, np.repeat(state, len(ids), axis=0), ids)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_against_differences():
    net = lm.new_net(some_counts())
    for f in net.__dataclass_fields__:
        setattr(net, f, getattr(net, f).astype(np.float64))
    rng = np.random.default_rng(2)
    ids = rng.integers(0, lm.NEURAL + 1 + lm.SPELLINGS, (6, 3))
    fresh = np.zeros((6, 3), dtype=bool)
    fresh[0, 1] = fresh[3, 0] = True
    start = rng.normal(size=(3, lm.HIDDEN))

    def loss():
        h, total = start, 0.0
        for t in range(6):
            h = h * ~fresh[t][:, None]
            total -= lm.log_probabilities(net, h, ids[t]).sum()
            h = lm.gated_step(net, net.embed[ids[t]] + net.bias, h)[0]
        return total / ids.size

    grads, _ = lm._window_gradients(net, ids, fresh, start)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [np.unravel_index(int(k), g.shape) for k in np.argsort(-np.abs(g).ravel())[:3]]:
            kept = p[at]
            p[at] = kept + 1e-4
            high = loss()
            p[at] = kept - 1e-4
            low = loss()
            p[at] = kept
            assert g[at] == pytest.approx((high - low) / 2e-4, rel=0.02, abs=2e-4)


def test_state_is_carried_over_windows_and_lanes(monkeypatch):
    net = lm.new_net(some_counts())
    rng = np.random.default_rng(4)
    lengths = np.array([1, 70, 3, 33, 200, 32])
    ids = rng.integers(0, lm.NEURAL + 1 + lm.SPELLINGS, lengths.sum())
    whole = []
    at = 0
    for n in lengths:
        h, total = np.zeros((1, lm.HIDDEN), dtype=np.float32), 0.0
        for word in ids[at : at + n]:
            total += lm.log_probabilities(net, h, np.array([word]))[0]
            h = lm.gated_step(net, net.embed[[word]] + net.bias, h)[0]
        whole.append(total)
        at += n
    for lanes in (2, 512):
        monkeypatch.setattr(lm, "LANES", lanes)
        assert lm.neural_scores(net, ids, lengths) == pytest.approx(np.array(whole), rel=1e-4)


def test_training_lowers_the_loss():
    net = lm.new_net(some_counts())
    ids = np.tile(np.array([3, 900, 17, 2060, 40, lm.END]), 30_000)
    fresh = np.tile(np.array([True] + [False] * 5), 30_000)
    before = lm.neural_scores(net, ids[:60], np.array([6] * 10)).sum()
    lm.train(net, ids, fresh, epochs=1)
    assert lm.neural_scores(net, ids[:60], np.array([6] * 10)).sum() > before + 20
