import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from regiometric.llm import simhash, substrings
from regiometric.llm.components import connected_components
from regiometric.llm.words import find_words, hash_words


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@settings(deadline=None, max_examples=50)
@given(st.lists(st.text(alphabet=" \t\nabAÉ,.日", max_size=30), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    import pyarrow as pa

    words = find_words(pa.array([*texts, None], pa.string()), lower=True)
    wanted = [text.encode().lower().split() for text in [*texts, ""]]
    data = words.data.tobytes()
    found = [
        [data[s:e] for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)]
        for a, b in zip(words.first[:-1], words.first[1:], strict=True)
    ]
    assert found == wanted
    flat = [w for text in wanted for w in text]
    hashes = hash_words(words)
    assert len(set(hashes.tolist())) == len(set(flat))


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for bits in (0, 1, 2, 3):
        other = base.copy()
        for k in range(len(base)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.uint64(1 << int(b))
        where, row, home = simhash.anchors(base)
        lives = set(zip(where[home].tolist(), row[home].tolist(), strict=True))
        where, row, _ = simhash.anchors(other)
        met = {r for a, r in zip(where.tolist(), row.tolist(), strict=True) if (a, r) in lives}
        assert len(met) == len(base)
        assert len(where) <= 34 * len(base)


def test_near_duplicates_against_brute_force(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    given_rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps = [plain_fingerprint(text) for _, text in given_rows]
    distinct = sorted(set(fps))
    close = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    root = groups(distinct, close)
    least = {}
    for (doc_id, _), fp in zip(given_rows, fps, strict=True):
        least.setdefault(root[fp], []).append(doc_id)
    wanted = Counter(
        (doc_id, f"{fp:016x}", min((i for i in least[root[fp]] if i is not None), default=None))
        for (doc_id, _), fp in zip(given_rows, fps, strict=True)
    )
    assert Counter(tuple(r) for r in rows) == wanted


def test_crowded_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_HOMES", 3)
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 7)
    center = 0x0123456789ABCDEF
    near = [center] + [center ^ (1 << a) for a in range(64)] + [center ^ (1 << a) ^ (3 << 40) for a in range(30)]
    signed = [n - (1 << 64) if n >> 63 else n for n in near]
    lone = 0x0F0F0F0F0F0F0F0F
    signed = [*dict.fromkeys(signed), lone]
    fps = spark.createDataFrame([(n,) for n in signed], "fp long")
    links = [tuple(r) for r in simhash.links(fps).collect()]
    assert {n for pair in links for n in pair} == set(signed) - {lone}
    assert len(set(groups(signed, links).values())) == 2


def test_near_duplicates_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    chain = [(k, k + 1) for k in range(40)]
    linked = chain + [tuple(map(int, rng.integers(100, 160, 2))) for _ in range(40)] + [(5, 5)]
    found = connected_components(spark.createDataFrame(linked, "a long, b long")).collect()
    nodes = {n for a, b in linked if a != b for n in (a, b)}
    root = groups(nodes, [pair for pair in linked if pair[0] != pair[1]])
    assert {r.node for r in found} == nodes and len(found) == len(nodes)
    names = {r.node: r.root for r in found}
    assert all((names[a] == names[b]) == (root[a] == root[b]) for a in nodes for b in nodes)


def plain_removal(texts, window):
    words = [(text or "").encode().split() for text in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


@pytest.mark.parametrize("window", [10, 35])
def test_repeated_runs_against_brute_force(odd_docs, window):
    given_rows = odd_docs.collect()
    wanted = Counter(
        (r.doc_id, *plain) for r, plain in zip(given_rows, plain_removal([r.text for r in given_rows], window), strict=True)
    )
    rows = substrings.remove_repeated(odd_docs, window=window, with_text=True, carry=["row", "k1"]).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, " ".join(r.kept_text.encode().split() and
                   [w.decode() for w in r.kept_text.encode().split()])) for r in rows)
    assert got == wanted
    assert {(r.row, r.k1) for r in rows} == {("r", 1)}
    text = {r.doc_id: r.text for r in given_rows}
    assert all(r.kept_text == (text[r.doc_id] or "") for r in rows if r.doc_id and r.doc_id != 12 and not r.n_removed)


@settings(deadline=None, max_examples=15)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_repeated_runs_of_periodic_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeated(docs, window=9).collect()}
    assert rows == {k: plain[:3] for k, plain in enumerate(plain_removal(texts, 9))}


def test_repeated_runs_of_nothing(no_docs):
    assert substrings.remove_repeated(no_docs).collect() == []
