import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from regiometric.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), size in zip(counted, sizes, strict=True):
            if not size:
                continue
            m = 100 - 25 + (25 * size * n) // total
            score = 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


def ordered(found):
    return sorted(found, key=lambda row: tuple((v is not None, str(v)) for v in row))


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def prose(rng, words, size):
    return " ".join(f"{rng.choice(['W', 'w', 'ä'])}{min(rng.expovariate(8 / words), words - 1):.0f}" + rng.choice(["", ",", " - "]) for _ in range(size))


@pytest.mark.parametrize("block, part", [(8 << 20, 200_000), (2000, 60)])
def test_against_brute_force(spark, rows, monkeypatch, block, part):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(3)
    docs = [(k, prose(rng, 300, rng.choice([0, 1, 5, 60, 200]))) for k in range(500)]
    docs += [(500 + k, docs[7][1] + " twin") for k in range(60)]  # a group of copies with equal scores
    items = [(k, prose(rng, 300, rng.randint(1, 30))) for k in range(40)] + [(40, docs[7][1]), (41, "zzz none"), (42, "twin Twin")]
    got = lexical.search(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"), part_terms=part)
    assert [name for name, _ in got.dtypes] == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == ordered(brute(docs, items))


def test_odd_rows(spark, rows, odd_docs, no_docs):
    items = [(1, "Prose ba ro"), (2, None), (3, ""), (4, "!!"), (None, "ti lem ÉTÉ né"), (5, "日本語 one"), (5, "日本語 one"), (6, "a a a")]
    bench = table(spark, [(*i, 1, 2.0) for i in items], "item_id long, text string, doc_id int, score double")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(docs, [i for k, i in enumerate(items) if k != 5])
    assert rows(lexical.search(odd_docs, bench)) == ordered(want)
    assert rows(lexical.search(no_docs, bench)) == []
    assert rows(lexical.search(odd_docs, bench.limit(0))) == []


def test_accumulators_stop_and_scores_stay_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        documents, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        lists, total = [], np.zeros(documents, dtype=np.int64)
        for _ in range(int(rng.integers(1, 8))):
            docs = np.flatnonzero(rng.random(documents) < rng.random())
            adds = rng.integers(0, 9, len(docs)) * int(rng.integers(1, 50))
            if len(docs):
                lists.append((docs, adds, int(adds.max())))
                total[docs] += adds
        lists.sort(key=lambda x: len(x[0]))
        threshold = int(rng.integers(0, 100))
        found, scores = lexical.rank_block(lists, documents, k, threshold)
        assert (scores == total[found]).all()
        best = np.lexsort((np.arange(documents), -total))[:k]
        best = [d for d in best if total[d] > 0 and total[d] >= threshold]
        assert set(best) <= set(found.tolist())


def test_frequent_terms_create_no_accumulators():
    rare, common = np.arange(5), np.arange(1000)
    lists = [(rare, np.full(5, 100), 100), (common, np.full(1000, 10), 10)]
    found, scores = lexical.rank_block(lists, 1000, 5, 0)
    assert found.tolist() == rare.tolist() and scores.tolist() == [110] * 5
