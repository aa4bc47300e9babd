import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from regiometric.llm import language_model as lm
from regiometric.llm.words import find_words, hash_words

from .conftest import SCHEMA, prose, row


def test_every_training_token_is_learned_from(spark, monkeypatch):
    """The weight of the averaged net, and what a learner goes through, are all tokens of all documents, ids or not."""
    monkeypatch.setattr(lm, "LEARNER_TOKENS", 3000)
    monkeypatch.setattr(lm, "AVERAGED", 3)
    rows = [row(k if k % 9 else None, prose(k, 20 + k % 50)) for k in range(400)] + [row(7, prose(1, 9000)), row(8, None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    counted = lm.count_words(docs)
    counts = lm.summarise(counted, len(rows))
    coded = lm.encode(docs, counts).collect()
    assert sum(len(r.ids) for r in coded) == counts.tokens and len(coded) == len(rows)
    seen = []
    stage = lm.stage

    def spy(df, name="stage"):
        out = stage(df, name)
        if name == "nets":
            seen.append([r.tokens for r in out.select("tokens").collect()])
        return out

    monkeypatch.setattr(lm, "stage", spy)
    net = lm.fit(docs, counts)
    assert len(seen) == lm.EPOCHS and all(sum(s) == counts.tokens and len(s) > 5 for s in seen)
    text = pa.array([prose(k, 60) for k in range(20)])
    words = find_words(text, lower=True)
    ids = lm._with_ends(lm.token_ids(words, hash_words(words), counts)[0], words.first)
    lengths = np.diff(words.first) + 1
    assert lm.neural_scores(net, ids, lengths).sum() > lm.neural_scores(lm.new_net(counts), ids, lengths).sum()


def test_packed_ids_are_the_ids(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    counts = lm.summarise(lm.count_words(docs), docs.count())
    plain, packed = lm.encode(docs, counts).toArrow(), lm.encode(docs, counts, packed=True).toArrow()
    assert plain.drop_columns("ids") == packed.drop_columns("ids")
    for part in (slice(0, None), slice(3, 7)):
        wanted, column = plain.column("ids")[part].to_pylist(), packed.column("ids").combine_chunks()[part]
        ids, sizes = lm._unpack(column)
        assert sizes.tolist() == [len(x) for x in wanted] and ids.tolist() == [i for x in wanted for i in x]


def test_a_task_counts_a_word_once(monkeypatch):
    texts = [*[prose(k % 3, 4000) for k in range(160)], None, "", *[prose(k) for k in range(9)]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > 4 << 20  # several slices
    words = find_words(batch.column("text"), lower=True)
    hashes, spelling = hash_words(words), lm.spellings(words)
    wanted = Counter(zip(hashes.view(np.int64).tolist(), spelling.tolist(), strict=True))
    rows = [tuple(x.values()) for part in lm._count([batch, batch]) for x in part.to_pylist()]
    assert len(rows) == len(wanted) and {(w, s): n for w, s, n in rows} == {k: 2 * n for k, n in wanted.items()}
    monkeypatch.setattr(lm, "COUNTED", 50)
    parts, found = list(lm._count([batch, batch])), Counter()
    for part in parts:
        for x in part.to_pylist():
            found[x["word"], x["spelling"]] += x["n"]
    assert len(parts) > 2 and found == {k: 2 * n for k, n in wanted.items()}
    assert list(lm._count([batch.slice(160, 2)])) == []


def test_words_are_found_in_the_list():
    rng = np.random.default_rng(5)
    far = np.array([0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63], dtype=np.uint64)
    near = np.uint64(7 << 50) + rng.integers(0, 300, 200).astype(np.uint64)  # many with the same first bits
    for words in (near[:0], far[:1], far[2:3], np.concatenate([near, far, rng.integers(0, 1 << 63, 5000).astype(np.uint64)])):
        words = np.unique(words)
        counts = lm.Counts(words, np.ones(len(words)), np.arange(len(words)), np.zeros(64), np.zeros(64), 1, 1, 1)
        asked = np.concatenate([words, words + np.uint64(1), words - np.uint64(1), near + np.uint64(1), far])
        at, listed = counts.find(asked)
        assert listed.tolist() == np.isin(asked, words).tolist() and (words[at[listed]] == asked[listed]).all()


def test_a_step_by_blocks_is_the_gated_unit():
    rng = np.random.default_rng(3)
    net = lm.Net(*[rng.normal(0, 1, shape).astype(np.float32) for shape in ((9, 96), (32, 96), (96,), (1,), (1,), (1,), (1,))])
    h, given = rng.uniform(-1, 1, (5, 32)).astype(np.float32), rng.normal(0, 1, (5, 96)).astype(np.float32)
    given[0, :64], given[1, :64] = 500, -500
    gate = 1 / (1 + np.exp(-np.clip((h @ net.u[:, :64] + given[:, :64]).astype(float), -80, 80)))
    update, reset = gate[:, :32], gate[:, 32:]
    candidate = np.tanh((reset * h) @ net.u[:, 64:] + given[:, 64:])
    after, gates, found = lm.gated_step(net, given, h)
    assert gates.shape == (2, 5, 32) and all(x.flags.c_contiguous for x in gates)
    assert np.allclose(after, h + update * (candidate - h), atol=1e-5) and np.allclose(found, candidate, atol=1e-5)


def test_a_learner_takes_every_word_once(monkeypatch):
    taken = []
    monkeypatch.setattr(lm.Learner, "_window", lambda self, ids, fresh, h: taken.extend(ids.ravel().tolist()) or h)
    net = lm.Net(*[np.zeros(1, dtype=np.float32)] * 7)
    for n in (1, 31, 64, 65, 5000, 2048 * 3 + 17):
        taken.clear()
        lm.Learner(net, 0, n).learn(np.arange(n), np.zeros(n, dtype=bool))
        assert sorted(taken) == list(range(n))


def test_a_steady_task_takes_its_memory_once():
    """Arrays that are freed and taken again, as in each window of the learner, are not cleared by the system each time."""
    code = """
import resource
import numpy as np
from regiometric.llm import language_model as lm

def faults():
    return resource.getrusage(resource.RUSAGE_SELF).ru_minflt

def run(batches):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, lm.NEURAL + 1 + lm.SPELLINGS, (lm.WINDOW, lm.STREAMS))
    fresh, h = np.zeros(ids.shape, dtype=bool), np.zeros((lm.STREAMS, lm.HIDDEN), dtype=np.float32)
    spread = np.full(lm.SPELLINGS, 7.0)
    words = np.arange(3000, dtype=np.uint64)
    net = lm.new_net(lm.Counts(words, words.astype(int) + 1, np.arange(3000), spread, spread, 1, 1, 1))
    for k in range(8):
        if k == 3:
            before = faults()
        kept = [np.ones(1 << 18) for _ in range(12)]  # 24 MB at once
        lm._window_gradients(net, ids, fresh, h)
        del kept
    yield (faults() - before) / 5

print(*lm.tidy(run, steady=True)([]))
"""
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 500  # of more than 6000 pages


def test_scores_against_one_word_at_a_time(spark, odd_docs, monkeypatch):
    """``score`` is the net's share of every word's output, times a rare word's smoothed share of its spelling."""
    monkeypatch.setattr(lm, "NEURAL", 63)
    monkeypatch.setattr(lm, "END", 63)
    monkeypatch.setattr(lm, "WORD_CLASSES", 1)
    monkeypatch.setattr(lm, "CLASSES", 1 + lm.SPELLINGS)
    monkeypatch.setattr(lm, "LISTED", 120)  # some rare words are listed, others joined
    monkeypatch.setattr(lm, "SCORED_TOKENS", 500)
    nets, learn_from = [], lm.learn_from
    monkeypatch.setattr(lm, "learn_from", lambda coded, counts: nets.append(learn_from(coded, counts)) or nets[0])
    extra = spark.createDataFrame([row(9000 + k, prose(k, 40) + " Zq%d" % (k % 4)) for k in range(80)], SCHEMA)
    docs = odd_docs.unionByName(extra)
    rows = lm.score_documents(docs).collect()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    def of_words(text):
        words = find_words(pa.array([text]), lower=True)
        return list(zip(hash_words(words).view(np.int64).tolist(), lm.spellings(words).tolist(), strict=True))

    split = [(doc_id, of_words(text)) for doc_id, text in given]
    counts = Counter(w for doc_id, words in split if not held(doc_id) for w in words)
    frequent = [w for (w, _), _ in sorted(counts.items(), key=lambda x: (-x[1], x[0][0]))][: lm.NEURAL]
    place = {w: k for k, w in enumerate(frequent)}
    tokens, distinct = Counter(), Counter()
    for (w, spelling), n in counts.items():
        if w not in place:
            tokens[spelling] += n
            distinct[spelling] += 1
    assert len(counts) > 120 and any(counts[w] == 0 for _, words in split for w in words)
    net, wanted = nets[0], []
    for doc_id, words in split:
        h, total = np.zeros((1, lm.HIDDEN), dtype=np.float32), 0.0
        for word in [*words, None] if len(words) <= 3000 else []:
            rare = word is not None and word[0] not in place
            one = lm.END if word is None else lm.NEURAL + 1 + word[1] if rare else place[word[0]]
            total += lm.log_probabilities(net, h, np.array([one]))[0] / math.log(10)
            if rare:
                total += math.log10((counts[word] + 1) / (tokens[word[1]] + distinct[word[1]] + 1))
            h = lm.gated_step(net, (net.embed + net.bias)[[one]], h)[0]
        if len(words) <= 3000:
            wanted.append((doc_id, len(words) + 1, total))
    got = [(r.doc_id, r.n_tokens, r.score) for r in rows if r.n_tokens <= 3001]
    order = [sorted(x, key=lambda y: (y[0] is None, y[0] or 0, y[1], y[2])) for x in (wanted, got)]
    assert [x[:2] for x in order[0]] == [x[:2] for x in order[1]]
    assert [x[2] for x in order[1]] == pytest.approx([x[2] for x in order[0]], rel=1e-4)
