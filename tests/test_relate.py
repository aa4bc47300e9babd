import math

import numpy as np
import pytest

from regiometric.operators import relate

X = [0.41, 0.52, 0.55, 0.61, 0.64, 0.70, 0.73]
Y = [1.1, 1.9, 1.6, 2.4, 2.2, 3.1, 2.7]


def two_sided_p(t, df):
    """Student t tail by numerical integration."""
    grid = np.linspace(0, abs(t), 200001)
    density = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(density, grid)


def points(spark, extra=()):
    return spark.createDataFrame([*zip(X, Y), *extra], "x double, y double")


def test_correlation_drops_incomplete_pairs(spark):
    row = relate.correlation(points(spark, [(0.5, None), (None, 2.0), (float("nan"), 1.0)]), "x", "y").first()
    assert row["n"] == 7 and row["r"] == pytest.approx(np.corrcoef(X, Y)[0, 1])


def test_correlation_test_figures(spark):
    row = relate.correlation_test(points(spark), "x", "y").first()
    r, n = np.corrcoef(X, Y)[0, 1], len(X)
    t = r * math.sqrt(n - 2) / math.sqrt(1 - r * r)
    assert (row["df"], row["t"]) == (n - 2, pytest.approx(t))
    assert row["p"] == pytest.approx(two_sided_p(t, n - 2), rel=1e-6)
    z, e = math.atanh(r), 1.959963984540054 / math.sqrt(n - 3)
    assert (row["ci_low"], row["ci_high"]) == (pytest.approx(math.tanh(z - e)), pytest.approx(math.tanh(z + e)))
    assert row["annotation"] == f"r = {round(r, 3)} , p < 0.01"


def test_interval_needs_four_pairs(spark):
    row = relate.correlation_interval(points(spark).limit(3), "x", "y").first()
    assert row["n"] == 3 and row["ci_low"] is None and row["t"] is not None


def test_simple_line_and_clipping(spark):
    slope, intercept = np.polyfit(X, Y, 1)
    row = relate.simple_line(points(spark), "x", "y").first()
    assert (row["slope"], row["intercept"], row["n"]) == (pytest.approx(slope), pytest.approx(intercept), 7)
    clipped = relate.simple_line(points(spark), "x", "y", clip_x=(0.5, 0.7), clip_y=(0, 3)).first()
    assert clipped["n"] == 4
    fitted = relate.fitted_values(points(spark), "x", relate.simple_line(points(spark), "x", "y"))
    assert sorted(r["fitted"] for r in fitted.collect()) == pytest.approx(sorted(np.polyval([slope, intercept], X)))


def test_least_squares_matches_normal_equations(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=40), rng.normal(size=40)
    y = 1 + 2 * a - b + rng.normal(size=40)
    data = [(float(p), float(q), float(v)) for p, q, v in zip(a, b, y)] + [(None, 1.0, 1.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(data, "a double, b double, y double")
    terms = {r["term"]: r for r in relate.ols(df, "y", ["a", "y", "b"]).collect()}
    design = np.column_stack([np.ones(40), a, b])
    beta, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 37)
    r2 = 1 - sse[0] / ((y - y.mean()) ** 2).sum()
    for i, name in enumerate(["(Intercept)", "a", "b"]):
        assert terms[name]["estimate"] == pytest.approx(beta[i])
        assert terms[name]["std_error"] == pytest.approx(error[i])
        assert terms[name]["p_value"] == pytest.approx(two_sided_p(beta[i] / error[i], 37), rel=1e-4, abs=1e-12)
    first = terms["a"]
    assert first["dropped_terms"] == ["y"] and (first["n"], first["df_residual"]) == (40, 37)
    assert first["r2"] == pytest.approx(r2)
    assert first["r2_adjusted"] == pytest.approx(1 - (1 - r2) * 39 / 37)
    assert first["residual_error"] == pytest.approx(math.sqrt(sse[0] / 37))
    assert first["f_value"] == pytest.approx((r2 / 2) / ((1 - r2) / 37))


def test_pair_matrix_levels_and_missing_sides(spark):
    df = spark.createDataFrame(
        [("N", 1.0, 2.0, 5.0), ("N", 2.0, 3.0, None), ("N", 3.0, 5.0, 1.0), (None, 4.0, 1.0, 2.0), (None, 5.0, 2.0, 9.0)],
        "g string, a double, b double, c double",
    )
    table = {(r["level"], r["group"], r["x"], r["y"]): r for r in relate.pair_matrix(df, ["a", "b", "c"], "g").collect()}
    assert len(table) == 3 * 3
    assert table["all", None, "a", "b"]["r"] == pytest.approx(np.corrcoef([1, 2, 3, 4, 5], [2, 3, 5, 1, 2])[0, 1])
    assert table["group", None, "a", "b"]["n"] == 2 and table["all", None, "a", "c"]["n"] == 4
    assert table["group", "N", "b", "c"]["r"] == pytest.approx(-1.0)
    assert relate.pair_matrix(df, ["a", "b"]).first()["level"] == "all"


def test_pair_points(spark, rows):
    df = spark.createDataFrame([("k", 1.0, 2.0, None)], "k string, a double, b double, c double")
    assert rows(relate.pair_points(df, ["k"], ["a", "b", "c"])) == [("k", "a", "b", 1.0, 2.0)]


def test_wide_rates_equal_a_chain_of_left_joins(spark, rows):
    schema = "regiao_saude string, rate double"
    a = spark.createDataFrame([("1", 0.1), ("2", 0.2), ("3", None)], schema)
    b = spark.createDataFrame([("1", 0.5), ("9", 0.9)], schema)
    c = spark.createDataFrame([("3", 0.7)], schema)
    wide = relate.rates_wide({"a": a, "b": b, "c": c})
    chain = a.withColumnRenamed("rate", "a")
    for name, df in (("b", b), ("c", c)):
        chain = chain.join(df.withColumnRenamed("rate", name), "regiao_saude", "left")
    assert rows(wide) == rows(chain.select(wide.columns))


def test_densities_recode_states_and_keep_unknown_ones(spark, rows):
    council = spark.createDataFrame([("SP", "Médicos", 30), ("XX", "Médicos", 5)], "uf_sigla string, profissionais string, qntd_profissionais bigint")
    census = spark.createDataFrame([("São Paulo", 10000)], "UF string, populacao bigint")
    long = relate.density_long(council, census)
    assert rows(long) == [("São Paulo", "Médicos", 3.0), ("XX", "Médicos", None)]
    wide = relate.density_wide(long, {"Médicos": "razao_medicos"})
    medians = spark.createDataFrame([("São Paulo", "Região Sudeste", 0.6), ("Acre", "Região Norte", None)], "uf string, regiao string, m double")
    assert rows(relate.medians_with_density(medians, wide, "uf")) == [
        ("AC", "Região Norte", None, None), ("SP", "Região Sudeste", 0.6, 3.0)
    ]


def test_density_points_inner_and_left(spark, rows):
    density = spark.createDataFrame([("35", "SP", 2.5), ("11", "RO", 1.0)], "cod_uf string, UF string, `Razão` double")
    rates = spark.createDataFrame([("35", "São Paulo", "SE", 0.2), ("35", "São Paulo", "SE", 0.6), ("35", "São Paulo", "SE", 0.7)], "cod_uf string, uf string, regiao string, rate double")
    assert rows(relate.density_points(density, rates)) == [("35", "SP", 2.5, "São Paulo", "SE", 0.5)]
    assert rows(relate.density_points(density, rates, stat="median", how="left")) == [
        ("11", "RO", 1.0, None, None, None), ("35", "SP", 2.5, "São Paulo", "SE", 0.6)
    ]
    with pytest.raises(ValueError):
        relate.density_points(density, rates, stat="mode")


def test_least_squares_with_terms_that_others_determine(spark):
    data = [(float(i), 2.0 * i + 1, 3.0, float(i * i % 7), float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, y double")
    full = {r["term"]: r for r in relate.ols(df, "y", ["a", "b", "c", "d"]).collect()}
    reduced = {r["term"]: r for r in relate.ols(df, "y", ["a", "d"]).collect()}
    assert list(full) == ["(Intercept)", "a", "b", "c", "d"]
    for name in reduced:
        assert full[name]["estimate"] == pytest.approx(reduced[name]["estimate"])
        assert full[name]["p_value"] == pytest.approx(reduced[name]["p_value"])
    assert full["b"]["estimate"] is None and full["c"]["std_error"] is None and full["b"]["df_residual"] == 9
    constant = relate.ols(df, "c", ["a"]).collect()
    assert constant[0]["estimate"] == pytest.approx(3.0) and constant[0]["p_value"] is None


def test_least_squares_needs_rows_and_features(spark):
    with pytest.raises(Exception, match="missing"):
        relate.ols(points(spark).filter("x > 2"), "y", ["x"]).collect()
    with pytest.raises(ValueError, match="feature"):
        relate.ols(points(spark), "y", ["y"])


def test_rates_wide_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("1", 0.1), ("1", 0.2), ("2", 0.3), (None, 0.4)], "regiao_saude string, rate double")
    b = spark.createDataFrame([("1", 0.5), ("1", 0.6), (None, 0.7), ("9", 0.8)], "regiao_saude string, rate double")
    found = sorted(map(tuple, relate.rates_wide({"a": a, "b": b}).collect()), key=str)
    wanted = [("1", 0.1, 0.5), ("1", 0.1, 0.6), ("1", 0.2, 0.5), ("1", 0.2, 0.6), ("2", 0.3, None), (None, 0.4, 0.7)]
    assert found == sorted(wanted, key=str)


def test_repeated_cells_are_an_error(spark):
    long = spark.createDataFrame([("x", "p", 1.0), ("x", "p", 2.0)], "UF string, profissionais string, razao_prof_hab double")
    with pytest.raises(Exception, match="more than one value for p"):
        relate.density_wide(long, {"p": "q"}).collect()


@pytest.mark.parametrize("t, df", [(0.0, 5), (0.3, 1), (1.0, 2), (2.5, 7), (-4.0, 30), (1.3, 1000), (3.0, 200_000)])
def test_t_tail(spark, t, df):
    from pyspark.sql import functions as F

    from regiometric.functions.tails import f_upper, t_two_sided

    both = spark.range(1).select(t_two_sided(F.lit(t), F.lit(df)).alias("p"), f_upper(F.lit(t * t), F.lit(1), F.lit(df)).alias("f"))
    row = both.first()
    wanted = two_sided_p(t, df) if df < 200 else math.erfc(abs(t) / math.sqrt(2))
    assert row["p"] == pytest.approx(wanted, rel=1e-6 if df < 200 else 0.01)
    assert row["f"] == pytest.approx(row["p"], rel=1e-9)


def test_correlation_test_builds_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    relate.correlation_test(points(spark), "x", "y")
    assert len(tracker.getJobIdsForGroup(None)) == before
