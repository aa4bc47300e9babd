from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regiometric.operators import ranking

slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
rates = st.lists(st.one_of(st.none(), st.sampled_from([0.1, 0.2, 0.3, 0.4]), st.floats(0, 1)), min_size=1, max_size=25)


def table(spark, values):
    return spark.createDataFrame([(f"{i:03d}", v) for i, v in enumerate(values)], "k string, v double").repartition(3)


@slow
@given(rates)
def test_positions_are_a_permutation_in_value_order(spark, values):
    got = {r["k"]: r["Ranking"] for r in ranking.order_number(table(spark, values), "v", ["k"]).collect()}
    present = [(-v, f"{i:03d}") for i, v in enumerate(values) if v is not None]
    want = {key: position for position, (_, key) in enumerate(sorted(present), start=1)}
    assert got == {f"{i:03d}": want.get(f"{i:03d}") for i in range(len(values))}


@slow
@given(rates, st.integers(1, 12))
def test_top_and_bottom_equal_rank_filters(spark, values, n):
    df = table(spark, values)
    for descending in (True, False):
        ranks = {}
        for i, v in enumerate(values):
            better = [w for w in values if w is not None and (v is None or (w > v if descending else w < v))]
            ranks[f"{i:03d}"] = 1 + len(better)
        got = {r["k"] for r in ranking.top_n(df, "v", n, descending).collect()}
        assert got == {key for key, rank in ranks.items() if rank <= n}


def test_many_equal_values_spread_over_partitions(spark):
    df = spark.range(5000).select(F.format_string("%05d", "id").alias("k"), F.lit(0.5).alias("v"))
    numbered = ranking.order_number(df, "v", ["k"])
    assert numbered.filter(F.col("Ranking") != F.col("k").cast("int") + 1).count() == 0
    assert numbered.select("Ranking").distinct().count() == 5000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 5000 rows would fit one partition
    try:
        sorted_rows = df.orderBy(F.col("v") + F.rand(1) * 0, "k")
        assert sorted_rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_top_needs_no_shuffle_of_rows(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    table(spark, [0.1, 0.2, 0.2, None]).write.parquet(path)
    df = ranking.top_n(spark.read.parquet(path), "v", 2)
    assert df.count() == 2
    result = ranking.top_n(spark.read.parquet(path), "v", 2)
    result.collect()
    assert "TakeOrderedAndProject" in plan(result) and "Join" not in plan(result)


def test_nan_is_missing(spark):
    df = table(spark, [0.1, float("nan"), 0.3])
    assert [r["v"] for r in ranking.top_n(df, "v", 1).collect()] == [0.3]
    assert {r["Ranking"] for r in ranking.order_number(df, "v", ["k"]).collect()} == {1, 2, None}
