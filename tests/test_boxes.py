import random

import numpy as np
import pytest

from regiometric.operators import boxes, describe


def plain(values, reach=1.5):
    v = np.array([x for x in values if x is not None])
    if not len(v):
        return (0, None, None, None, None, None, 0)
    q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    inside = v[(v >= low) & (v <= high)]
    return (len(v), q1, median, q3, inside.min(), inside.max(), int(len(v) - len(inside)))


@pytest.mark.parametrize("few, domain", [(100_000, (0.0, 1.0)), (0, (0.0, 1.0)), (0, (0.4, 0.41)), (0, (-1e6, 1e6))])
def test_counted_boxes_against_all_values(spark, monkeypatch, few, domain):
    monkeypatch.setattr(boxes, "FEW_VALUES", few)
    rng = random.Random(5)
    rows = [("big", rng.gauss(0.5, 0.1) if k % 50 else rng.choice([-3.0, 9.0])) for k in range(4000)]
    rows += [("ties", rng.choice([0.1, 0.2, 0.2, 0.2, 0.9])) for _ in range(500)]
    rows += [("same", 0.25)] * 40 + [("two", 0.1), ("two", 0.7), ("one", 5.0), ("none", None), (None, 0.3), (None, None), (None, 0.6)]
    rows += [("narrow", 0.5 + k * 1e-9) for k in range(1000)] + [("narrow", 0.9)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in describe.box_stats(df, ["g"], "v", domain=domain, staged=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, row in got.items():
        wanted = plain([v for k, v in rows if k == g])
        found = [row[name] for name in ("n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")]
        assert [v is None for v in found] == [v is None for v in wanted]
        found, wanted = ([v for v in values if v is not None] for values in (found, wanted))
        assert found == pytest.approx(wanted, rel=1e-12), g


def test_both_forms_agree_on_several_keys_and_a_clip(spark, rows):
    rng = random.Random(6)
    data = [(rng.choice("ab"), rng.choice([None, 1, 2]), rng.expovariate(2)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, v double")
    columns = ["g", "k", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    one, other = (describe.box_stats(df, ["g", "k"], "v", clip=(0.0, 1.5), staged=s).select(columns) for s in (True, False))
    assert rows(one) == rows(other)
    assert describe.box_stats(df.limit(0), ["g"], "v", staged=True).count() == 0
