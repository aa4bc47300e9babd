import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.operators import describe

slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def table(spark, pairs):
    return spark.createDataFrame(pairs, "g string, v double")


def test_means_of_groups_with_missing_values(spark, rows):
    df = table(spark, [("a", 0.2), ("a", 0.4), ("b", 0.5), ("b", None), (None, 0.1)])
    assert rows(describe.group_means(df, ["g"], "v")) == [(None, 0.1), ("a", pytest.approx(0.3)), ("b", None)]
    assert rows(describe.group_means(df, ["g"], "v", strict=False))[2] == ("b", 0.5)


def test_medians_with_label(spark, rows):
    df = table(spark, [("a", 0.5), ("a", 0.75), ("b", 0.125)])
    assert rows(describe.group_medians(df, ["g"], "v", label="t")) == [("a", 0.625, "62%"), ("b", 0.125, "12%")]


def test_overall_leaves_the_excluded_state_out(spark):
    df = table(spark, [("DF", 0.9), ("SP", 0.2), ("SP", 0.4), (None, 0.8)])
    every = describe.overall(df, "v").first()
    assert (every["n"], every["media"], every["mediana"]) == (4, pytest.approx(0.575), pytest.approx(0.6))
    without = describe.overall(df, "v", F.col("g") == "DF").first()
    assert (without["n"], without["media"]) == (2, pytest.approx(0.3))
    gap = describe.overall(df.union(table(spark, [("SP", None)])), "v").first()
    assert gap["media"] is None and gap["mediana"] is None


def test_six_numbers(spark):
    row = describe.six_numbers(table(spark, [("a", v) for v in (0.1, 0.2, 0.3, 0.6)]), ["g"], "v").first()
    want = {"min": 0.1, "q1": 0.175, "median": 0.25, "mean": 0.3, "q3": 0.375, "max": 0.6}
    assert {name: row[name] for name in want} == pytest.approx(want)


@slow
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_box_order_and_whiskers(spark, values):
    row = describe.box_stats(table(spark, [("a", v) for v in values]), ["g"], "v").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    reach = 1.5 * (row["q3"] - row["q1"])
    inside = [v for v in values if row["q1"] - reach <= v <= row["q3"] + reach]
    assert row["q1"] == pytest.approx(q1, abs=1e-12) and row["q3"] == pytest.approx(q3, abs=1e-12)
    assert row["q1"] <= row["median"] <= row["q3"]
    assert (row["whisker_low"], row["whisker_high"]) == (min(inside), max(inside))
    assert row["n_outliers"] == len(values) - len(inside)


def test_outliers_and_clipping(spark, rows):
    df = table(spark, [("a", v) for v in (0.5, 0.51, 0.52, 0.53, 0.54, 0.99, 1.4)] + [(None, 0.3)])
    assert rows(describe.box_outliers(df, ["g"], "v")) == [("a", 1.4)]
    clipped = {r["g"]: r for r in describe.box_stats(df, ["g"], "v", clip=(0.0, 1.0)).collect()}
    assert clipped["a"]["n"] == 6 and clipped["a"]["whisker_high"] == 0.54 and clipped["a"]["n_outliers"] == 1
    assert clipped[None]["median"] == 0.3


def test_category_order_by_median(spark, rows):
    df = table(spark, [("low", 0.1), ("low", 0.9), ("low", 0.2), ("high", 0.6), ("mid", 0.3), ("mid2", 0.3)])
    order = describe.category_order(df, "g", "v").select("ord", "g")
    assert rows(order) == [(1, "high"), (2, "mid"), (3, "mid2"), (4, "low")]
    joined = describe.with_order(df, order, "g")
    assert {(r["g"], r["ord"]) for r in joined.collect()} == {("high", 1), ("mid", 2), ("mid2", 3), ("low", 4)}


def test_states_ordered_by_macro_region_number(spark):
    df = spark.createDataFrame(
        [("Paraná", "Região Sul", 0.5), ("Bahia", "Região Nordeste", 0.4), ("Acre", "Região Norte", 0.6),
         (fixed.FEDERAL_DISTRICT, "Região Centro-Oeste", 0.7)],
        "uf string, regiao string, v double",
    )
    table_ = describe.state_box(
        df, "uf", "regiao", "v", fixed.MACRO_REGION_ORDER, F.col("uf") == fixed.FEDERAL_DISTRICT
    )
    assert {r["uf"]: r["ord"] for r in table_.collect()} == {"Bahia": 1, "Acre": 2, "Paraná": 3}
