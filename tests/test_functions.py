import pytest
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import (
    category_number,
    classify_prefix,
    missing_to_null,
    municipality_code,
    numeric_code,
    p_label,
    percent_label,
    percent_of,
    period_equals,
    r_label,
    ratio,
    recode,
    strip_all,
    strip_lead,
    text_code,
)


def values(spark, items, kind, make):
    df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_municipality_code_looks_at_length_before_the_district_prefix(spark):
    given = ["3550308", "355030", "5300108", "530020", "5300", None]
    want = ["355030", "355030", "530010", "530010", "530010", None]
    assert values(spark, given, "string", municipality_code) == want
    assert values(spark, ["5301234"], "string", municipality_code) == ["530123"]


def test_first_matching_prefix_wins(spark):
    given = ["010100", "010300", "040300", "040100", "100001", "050000", "990000", "", None]
    want = [
        fixed.BOND_PROTECTED, fixed.BOND_PRECARIOUS, fixed.BOND_OTHER, fixed.BOND_PRECARIOUS, fixed.BOND_PROTECTED,
        fixed.BOND_OTHER, fixed.BOND_UNKNOWN, fixed.BOND_UNKNOWN, fixed.BOND_UNKNOWN,
    ]
    assert values(spark, given, "string", classify_prefix) == want
    rules = [("1", "short"), ("12", "never")]
    assert values(spark, ["123", "2"], "string", lambda c: classify_prefix(c, rules, "none")) == ["short", "none"]


def test_codes_at_the_source_boundary(spark):
    assert values(spark, [" 53001", "", None], "string", text_code) == ["53001", None, None]
    assert values(spark, [53001, None], "int", text_code) == ["53001", None]
    assert values(spark, ["53001", "x1", None], "string", numeric_code) == [53001, None, None]


def test_period_and_prefix_filters_reach_the_scan(spark, tmp_path, plan):
    path = str(tmp_path / "registry")
    spark.createDataFrame(
        [("202201", "223505"), ("202202", "223505"), ("202201", "322205")], "COMPETEN string, CBO string"
    ).write.parquet(path)
    df = spark.read.parquet(path).filter(period_equals("COMPETEN", 2022, 1) & F.col("CBO").startswith("2235"))
    assert df.count() == 1
    text = plan(df)
    assert "EqualTo(COMPETEN,202201)" in text and "StringStartsWith(CBO,2235)" in text


def test_recode_keeps_unmatched_values(spark):
    given = ["SP", "XX", None]
    assert values(spark, given, "string", lambda c: recode(c, fixed.STATES)) == ["São Paulo", "XX", None]
    there_and_back = lambda c: recode(recode(c, fixed.STATES), fixed.STATE_CODES)
    assert values(spark, list(fixed.STATES), "string", there_and_back) == list(fixed.STATES)


def test_macro_region_labels(spark):
    given = ["Região Sul", "Sul", "A Região Sul", None]
    assert values(spark, given, "string", strip_lead) == ["Sul", "Sul", "A Região Sul", None]
    assert values(spark, given, "string", strip_all) == ["Sul", "Sul", "A  Sul", None]
    assert values(spark, given, "string", category_number) == [1, None, None, None]


def test_percent_labels_round_halves_to_even(spark):
    assert values(spark, [0.125, 0.375, 0.62, None], "double", percent_label) == ["12%", "38%", "62%", None]


def test_annotation_text(spark):
    given = [0.0099, 0.01, 0.05, 0.0456, 1.0, None]
    want = ["p < 0.01", "p = 0.01", "p = 0.05", "p = 0.046", "p = 1", None]
    assert values(spark, given, "double", p_label) == want
    assert values(spark, [0.5], "double", lambda c: r_label(c, F.lit(0.02))) == ["r = 0.5 , p = 0.02"]
    assert values(spark, [-0.1234], "double", lambda c: r_label(c, F.lit(0.001))) == ["r = -0.123 , p < 0.01"]


def test_shares_round_half_up_and_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(1, 800), (1, 3), (5, 0), (None, 4)], "a bigint, b bigint")
    assert [r[0] for r in df.select(percent_of("a", "b")).collect()] == [0.13, 33.33, None, None]
    assert [r[0] for r in df.select(ratio("a", "b", 1000)).collect()][2:] == [None, None]
    assert df.select(ratio("a", "b", 1000)).first()[0] == pytest.approx(1.25)


def test_nan_is_missing(spark):
    assert values(spark, [float("nan"), 1.0, None], "double", missing_to_null) == [None, 1.0, None]


def test_numeric_codes_may_be_whole_valued_decimals(spark):
    from regiometric.functions import numeric_code

    df = spark.createDataFrame([("11001.0",), (" 011001 ",), ("11001.5",), ("x",), ("",), (None,), ("7.",)], "c string")
    assert [r[0] for r in df.select(numeric_code("c")).collect()] == [11001, 11001, None, None, None, None, 7]
    assert [r[0] for r in spark.range(1).selectExpr("CAST(11001 AS DOUBLE) AS c").select(numeric_code("c")).collect()] == [11001]


def test_database_options_allow_a_parallel_read():
    from regiometric.sources.readers import jdbc_options

    bounds = {"partitionColumn": "k", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    options = jdbc_options("jdbc:x", "SELECT k FROM t", bounds)
    assert options == {"url": "jdbc:x", "dbtable": "(SELECT k FROM t) source", **bounds}
