from collections import defaultdict

import numpy as np
import pytest

from regiometric.llm import neighbours

from .test_texts import vectors


@pytest.mark.parametrize("noise", [0.0, 1e-6, 1e-3])
def test_recall_with_a_third_in_one_group(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    group = rng.permutation(6000)[:2000]
    x[group] = x[group[0]] + noise * rng.normal(size=(2000, 32))
    x = x.astype(np.float32).astype(float)
    got = defaultdict(dict)
    for r in neighbours.nearest(vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])).collect():
        got[r.query_id][r.rank] = r.vec_id
    hits, asked = 0, [q for q in range(0, 6000, 100) if q in set(group.tolist())]
    for query in asked:
        d = np.sqrt(((x - x[query]) ** 2).sum(1))
        d[query] = np.inf
        right = np.lexsort((np.arange(6000), d))[:10].tolist()
        hits += len(set(right) & set(got[query].values()))
        if noise == 0:
            assert [got[query][n] for n in range(1, 11)] == right
    assert hits / (10 * len(asked)) >= 0.9
