import math

import numpy as np
import pytest

from regiometric.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double, tree string"


def table(spark, data):
    return spark.createDataFrame([(*row, 1, 0.5, "t") for row in data], SCHEMA)


def brute(data, positives=5, negatives=10, low=30, high=90):
    use = {}
    for key, x, label in data:
        if key is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        use[key] = min(use.get(key, row), row)
    out = []
    for a, (label, v) in use.items():
        if a % 100:
            continue
        scores = {b: sum(p * q for p, q in zip(v, w, strict=True)) for b, (_, w) in use.items() if b != a}
        first = sorted((-s, b) for b, s in scores.items() if use[b][0] == label)[:positives]
        for minus, p in first:
            s_p = -minus
            fit = sorted((-s, b) for b, s in scores.items() if use[b][0] != label and low * s_p <= 100 * s <= high * s_p)
            out += [(a, p, r, b, s_p, -m) for r, (m, b) in enumerate(fit[:negatives], 1)]
    return out


def ordered(found):
    return sorted(found, key=lambda row: tuple((v is not None, str(v)) for v in row))


def clusters(seed, n, d, noise=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + noise * rng.normal(size=(n, d))
    return x.astype(np.float32), rng.integers(0, 4, n)


@pytest.mark.parametrize("stripe_rows, tree_anchors", [(8192, 64), (300, 3)])
def test_against_brute_force(spark, rows, stripe_rows, tree_anchors):
    x, label = clusters(1, 2500, 8)
    x[500:1300] = x[500]  # a group of equal vectors, anchors among them
    data = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    got = hn.mine(table(spark, data), stripe_rows=stripe_rows, tree_anchors=tree_anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows(got) == ordered(brute(data))


def test_odd_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [9.0, 9.0], 2), (1, [1.0, 1.5], 1), (2, [0.5, 1.0], 2), (3, None, 1),
        (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (8, [], 2),
        (100, [0.0, 0.0], 2), (200, [-1.0, -2.0], 1), (9, [0.25, 0.5], 3), (10, [0.0, 0.0], 3), (11, [0.25, 0.5], 3),
        (300, [0.125, 0.25], 2), (12, [1.0, 1.5], 1), (12, [1.0, 1.5], 1),
    ]
    assert rows(hn.mine(table(spark, data))) == ordered(brute(data))
    assert rows(hn.mine(table(spark, [*data, (13, [1.0], 1)]))) == ordered(brute(data))
    assert rows(hn.mine(table(spark, []))) == []
    assert rows(hn.mine(table(spark, data[3:5]))) == []


def test_large_components_stay_exact(spark, rows):
    rng = np.random.default_rng(4)
    x = (rng.integers(-(1 << 20), 1 << 20, (400, 5)) / 256 * 64).astype(np.float32)
    data = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    assert rows(hn.mine(table(spark, data))) == ordered(brute(data))


def test_bounds_hold_and_save_scoring():
    x, _ = clusters(2, 3000, 16, noise=0.05)
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    anchors = v[:40]
    order, parents = hn.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(40)) and all(p < k for k, p in enumerate(parents))
    stripe = hn.Stripe(np.arange(len(v)), np.zeros(len(v)), v)
    for k, parent in zip(order, parents, strict=True):
        exact = v @ anchors[k]

        def wanted(low, high, exact=exact):
            assert (low <= exact).all() and (exact <= high).all()
            return high >= np.sort(low)[-5]

        at, scores = stripe.visit(anchors[k], int(parent), wanted)
        assert (scores == exact[at]).all() and set(np.argsort(-exact)[:3]) <= set(at.tolist())
    assert stripe.scored < 0.5 * 40 * len(v)
