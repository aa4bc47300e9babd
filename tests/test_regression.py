import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regiometric.operators import regression as reg


def data(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        g = rng.choice(["x", "x", "x", "y", None])  # one group holds most rows
        y = 2 + 3 * a - b + rng.gauss(0, 0.5)
        if k % 13 == 0:
            a = None
        if k % 17 == 0:
            b = math.nan
        out.append((k, g, a, b, 2 * b if b is not None else None, y))
    return out


SCHEMA = "key int, g string, a double, b double, twice double, y double"


def plain(rows, columns):
    whole = [r for r in rows if all(r[c] is not None and not math.isnan(r[c]) for c in columns)]
    y, x = np.array([r[columns[0]] for r in whole]), np.array([[1.0, *[r[c] for c in columns[1:]]] for r in whole])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - x @ beta
    inverse = np.linalg.inv(x.T @ x)
    error = np.sqrt(residual @ residual / (len(y) - x.shape[1]) * np.diag(inverse))
    return [r[0] for r in whole], beta, error, residual, np.einsum("ij,jk,ik->i", x, inverse, x)


def test_terms_rows_and_residuals_per_group(spark):
    rows = data(1, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    terms = {(r.g, r.term): r for r in reg.ols(df, "y", ["a", "b"], ["g"]).collect()}
    lines = {r.key: r for r in reg.ols_rows(df, "y", ["a", "b"], ["g"]).collect()}
    five = {r.g: r for r in reg.residual_summary(df, "y", ["a", "b"], ["g"]).collect()}
    seen = 0
    for g in ("x", "y", None):
        keys, beta, error, residual, leverage = plain([r for r in rows if r[1] == g], [5, 2, 3])
        for k, name in enumerate(["(Intercept)", "a", "b"]):
            assert terms[g, name].estimate == pytest.approx(beta[k]) and terms[g, name].std_error == pytest.approx(error[k])
            assert terms[g, name].n == len(keys)
        for key, r, h in zip(keys, residual, leverage, strict=True):
            assert lines[key].residual == pytest.approx(r) and lines[key].leverage == pytest.approx(h)
        wanted = [residual.min(), *np.quantile(residual, [0.25, 0.5, 0.75]), residual.max()]
        assert [five[g][q] for q in ("min", "q1", "median", "q3", "max")] == pytest.approx(wanted)
        seen += len(keys)
    assert seen == len(lines) and len(terms) == 9


def test_whole_table_and_a_term_that_another_determines(spark):
    rows = data(2, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    keys, beta, error, residual, leverage = plain(rows, [5, 2, 3])
    terms = {r.term: r for r in reg.ols(df, "y", ["a", "b", "twice"]).collect()}
    assert terms["twice"].estimate is None and terms["b"].estimate == pytest.approx(beta[2])
    lines = {r.key: r for r in reg.ols_rows(df, "y", ["a", "b", "twice"]).collect()}
    assert [lines[k].leverage for k in keys] == pytest.approx(list(leverage))
    assert sum(r.leverage for r in lines.values()) == pytest.approx(3)
    summary = reg.residual_summary(df, "y", ["a", "b"]).first()
    assert summary.n == len(keys) and summary["median"] == pytest.approx(np.median(residual))


def test_too_few_rows_and_a_constant_response(spark):
    df = spark.createDataFrame([(0, "x", 1.0, 2.0, 4.0, 5.0), (1, "x", 2.0, 2.0, 4.0, 5.0)], SCHEMA)
    terms = {r.term: r for r in reg.ols(df, "y", ["a", "b"]).collect()}
    assert terms["(Intercept)"].estimate == pytest.approx(5.0) and terms["a"].p_value is None and terms["a"].r2 is None
    assert terms["b"].estimate is None and terms["a"].df_residual == 0
    assert reg.ols(df.limit(0), "y", ["a"], ["g"]).count() == 0
    with pytest.raises(Exception, match="without missing"):
        reg.ols(df.limit(0), "y", ["a"]).collect()


def test_nothing_runs_while_models_are_built(spark, plan):
    df = spark.createDataFrame(data(3, 50), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    tables = [reg.ols(df, "y", ["a", "b"], by) for by in ([], ["g"])]
    tables += [reg.ols_rows(df, "y", ["a", "b"], ["g"]), reg.residual_summary(df, "y", ["a", "b"])]
    assert len(tracker.getJobIdsForGroup(None)) == before
    for table in tables:
        table.collect()
        assert "CartesianProduct" not in plan(table) and "NestedLoop" not in plan(table) and "Python" not in plan(table)


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame(data(4, 60), SCHEMA).withColumns({"n": F.lit(7), "means": F.lit("m"), "free": F.lit(1)})
    rows = reg.ols_rows(df, "y", ["a"], ["g"])
    assert rows.columns == [*df.columns, "fitted", "residual", "leverage"] and {r.n for r in rows.collect()} == {7}
