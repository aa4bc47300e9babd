import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiometric.operators.quantiles import exact_quantiles, medians

PROBS = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def check(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "g string, v double").repartition(3)
    got = {row["g"]: row for row in exact_quantiles(df, ["g"], "v", PROBS, **options).collect()}
    groups = {}
    for group, value in pairs:
        groups.setdefault(group, []).append(value)
    assert set(got) == set(groups)
    for group, items in groups.items():
        present = [v for v in items if v is not None and not math.isnan(v)]
        row = got[group]
        assert (row["n"], row["n_missing"]) == (len(present), len(items) - len(present))
        if not present:
            assert all(row[name] is None for name in [*PROBS, "mean", "min", "max"])
            continue
        assert (row["min"], row["max"]) == (min(present), max(present))
        assert row["mean"] == pytest.approx(np.mean(present), rel=1e-9, abs=1e-12)
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(present, p), rel=1e-12, abs=1e-12)


@slow
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(st.none(), st.sampled_from([0.0, 0.5, 1.0, float("nan")]), st.floats(-2, 3)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_agrees_with_sorting_for_any_values(spark, pairs):
    check(spark, pairs)


@slow
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.floats(-1e9, 1e9)), min_size=1, max_size=40))
def test_two_levels_between_the_data_range(spark, pairs):
    check(spark, pairs, domain=None)


@pytest.mark.parametrize("options", [{"levels": 1}, {"domain": None}, {"domain": (0, 1), "levels": 3}, {"staged": True}])
def test_long_tails_infinite_values_and_one_value_only(spark, options):
    singles = [("b", 1e-12), ("b", 1e12), ("c", 0.5), ("d", None)]
    check(spark, [("a", math.exp(i / 3.0)) for i in range(90)] + singles, **options)


def test_infinite_values_keep_the_order(spark):
    df = spark.createDataFrame([(v,) for v in [math.inf, -math.inf, 0.2, 0.4, 0.6]], "v double")
    row = exact_quantiles(df, [], "v", {"low": 0.0, "m": 0.5, "high": 1.0}, domain=None).first()
    assert (row["low"], row["m"], row["high"]) == (-math.inf, 0.4, math.inf)


def test_a_hot_group_and_a_hot_value(spark):
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.when(F.col("id") % 5 == 0, 0.5).otherwise(F.rand(3)).alias("v"),
    )
    df = spark.createDataFrame(df.collect(), df.schema)
    probs = [0.25, 0.5, 0.75]
    want = {
        r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect()
    }
    got = exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75})
    for row in got.collect():
        assert [row["a"], row["b"], row["c"]] == pytest.approx(want[row["g"]], abs=1e-15)


def test_whole_table_and_empty_table(spark):
    df = spark.createDataFrame([(0.2,), (0.4,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(0.3)
    assert exact_quantiles(df.filter("v > 1"), [], "v", {"m": 0.5}).count() == 0


def test_strict_and_lenient_medians_of_several_columns(spark, rows):
    df = spark.createDataFrame(
        [("a", 0.1, 0.2), ("a", 0.3, None), ("b", 0.5, 0.7), (None, 0.9, 0.1)], "g string, x double, y double"
    )
    assert rows(medians(df, ["g"], {"mx": "x", "my": "y"})) == [(None, 0.9, 0.1), ("a", 0.2, 0.2), ("b", 0.5, 0.7)]
    assert rows(medians(df, ["g"], {"mx": "x", "my": "y"}, strict=True)) == [
        (None, 0.9, 0.1), ("a", 0.2, None), ("b", 0.5, 0.7)
    ]
    assert rows(medians(df, ["g"], {"my": "y"}, strict=True)) == [(None, 0.1), ("a", None), ("b", 0.7)]


def test_no_group_is_gathered_by_a_percentile_buffer(spark, plan):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "g string, v double")
    result = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    result.collect()
    text = plan(result)
    assert "percentile" not in text and "collect_" not in text and "Cartesian" not in text and "NestedLoop" not in text
