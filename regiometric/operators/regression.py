"""Least squares in one aggregation: moments per group, elimination in column expressions, figures per term and per row.

Nothing is fitted on the driver and no job runs while a model is built. Means and covariances of all columns are added
up in one mergeable aggregate; a sweep over the features turns the covariances of a group into its coefficients, the
inverse for standard errors and what is left of the response.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric.functions import missing_to_null
from regiometric.functions.tails import f_upper, t_two_sided
from regiometric.operators.quantiles import exact_quantiles

TOLERANCE = 1e-12
SALTS = 32
#: Residuals are expected within so many residual standard errors; more distant ones only cost time.
SPREAD = 4.0
RESIDUAL_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _kept(response: str, features: Sequence[str]) -> list[str]:
    kept = [feature for feature in dict.fromkeys(features) if feature != response]
    if not kept:
        raise ValueError("no feature besides the response")
    return kept


def _complete(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, *[missing_to_null(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna(
        subset=[f"_x{i}" for i in range(len(columns))]
    )


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``means`` and ``cov`` (row by row) of the rows without a missing value, from one aggregation."""
    p = len(columns)
    cell = {(i, j): f"_c{i}_{j}" for i, j in combinations_with_replacement(range(p), 2)}
    found = _complete(df, columns, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"_x{i}") for i in range(p)]).alias("means"),
        *[F.covar_pop(f"_x{i}", f"_x{j}").alias(name) for (i, j), name in cell.items()],
    )
    whole = [F.col(cell[min(i, j), max(i, j)]) for i in range(p) for j in range(p)]
    return found.select(*by, "n", "means", F.array(*whole).alias("cov"))


def _sweep(p: int, pivots: int) -> Column:
    """The array ``cov`` swept by the first ``pivots`` columns in turn, and which of them kept variance of their own.

    A column that those before it determine, or a constant, is passed over. Written as text, which is parsed as a whole.
    """
    row, column = f"s.a[i * {p} + j]", f"s.a[j * {p} + k]"
    pivot = f"s.a[j * {p} + j]"
    cell = f"""CASE WHEN i = j AND k = j THEN -1 / {pivot} WHEN i = j THEN {column} / {pivot} WHEN k = j THEN {row} / {pivot}
                    ELSE s.a[i * {p} + k] - {row} * {column} / {pivot} END"""
    swept = f"flatten(transform(sequence(0, {p - 1}), i -> transform(sequence(0, {p - 1}), k -> {cell})))"
    free = f"{pivot} > {TOLERANCE}D * cov[j * {p} + j]"
    step = f"""named_struct('a', if({free}, {swept}, s.a), 'free', transform(s.free, (was, i) -> was OR (i = j AND {free})))"""
    start = f"named_struct('a', cov, 'free', array_repeat(false, {pivots}))"
    return F.expr(f"aggregate(sequence(0, {pivots - 1}), {start}, (s, j) -> {step})")


def model(df: DataFrame, response: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n``, ``means``, ``beta`` (intercept first; NULL for passed-over terms), ``inverse`` (of the
    centred cross products, 0 for them), ``free`` (whether each feature takes part), ``df_residual``, ``rss``, ``tss``.

    A table without any complete row is an error when the model is computed; such a group has no row.
    """
    kept = _kept(response, features)
    k, p = len(kept), len(kept) + 1
    found = moments(df, [*kept, response], by)
    if not by:
        empty = F.raise_error(F.lit("no row without missing values")).cast("array<double>")
        found = found.withColumn("cov", F.when(F.col("n") > 0, F.col("cov")).otherwise(empty))
    swept = found.withColumn("_s", _sweep(p, k)).select(*by, "n", "means", "cov", "_s.a", "_s.free")
    slopes = [f"if(free[{j}], a[{j * p + k}], NULL)" for j in range(k)]
    intercept = " - ".join([f"means[{k}]", *[f"coalesce({slope}, 0D) * means[{j}]" for j, slope in enumerate(slopes)]])
    inverse = [f"if(free[{i}] AND free[{j}], -a[{i * p + j}] / n, 0D)" for i in range(k) for j in range(k)]
    return swept.select(
        *by, "n", "means", "free",
        F.expr(f"array({', '.join([intercept, *slopes])})").alias("beta"),
        F.expr(f"array({', '.join(inverse)})").alias("inverse"),
        F.expr("n - 1 - size(filter(free, x -> x))").alias("df_residual"),
        F.expr(f"n * greatest(a[{p * p - 1}], 0D)").alias("rss"),
        F.expr(f"n * cov[{p * p - 1}]").alias("tss"),
    )


def _form(inverse: str, left: Sequence[str]) -> str:
    """The quadratic form of the inverse, as text."""
    k = len(left)
    return " + ".join(f"({left[i]}) * ({left[j]}) * {inverse}[{i * k + j}]" for i in range(k) for j in range(k))


def ols(df: DataFrame, response: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least squares with intercept: one row per term (and group), model figures repeated.

    Rows with a missing value are left out. A feature equal to the response is dropped and listed in
    ``dropped_terms``. A feature that earlier ones determine (or a constant) stays as a term without figures. Terms of a
    constant response have estimates only. NULL groups are groups. Building the table runs no job.
    """
    kept = _kept(response, features)
    dropped = [feature for feature in features if feature == response]
    k = len(kept)
    found = model(df, response, features, by).selectExpr(
        "*", "try_divide(tss - rss, tss) AS r2", "size(filter(free, x -> x)) AS terms",
        "if(df_residual > 0 AND tss > 0, try_divide(rss, double(df_residual)), NULL) AS variance",
    )
    spread = [f"1 / n + {_form('inverse', [f'means[{j}]' for j in range(k)])}"]
    spread += [f"if(free[{j}], inverse[{j * k + j}], NULL)" for j in range(k)]
    names = ["(Intercept)", *kept]
    rows = [
        F.struct(F.lit(name).alias("term"), F.expr(f"beta[{i}]").alias("estimate"), F.expr(f"sqrt(variance * ({spread[i]}))").alias("std_error"))
        for i, name in enumerate(names)
    ]
    table = found.select(
        *by, F.inline(F.array(*rows)), "n", F.expr("bigint(df_residual)").alias("df_residual"), "r2",
        F.expr("if(df_residual > 0, 1 - (1 - r2) * (n - 1) / df_residual, NULL)").alias("r2_adjusted"),
        F.expr("if(df_residual > 0, sqrt(try_divide(rss, double(df_residual))), NULL)").alias("residual_error"),
        F.expr("if(df_residual > 0, try_divide(try_divide(r2, double(terms)), (1 - r2) / df_residual), NULL)").alias("f_value"),
        F.array(*[F.lit(name) for name in dropped]).cast("array<string>").alias("dropped_terms"), "terms",
    )
    t_value = F.try_divide("estimate", "std_error")
    table = table.select("*", t_value.alias("t_value")).select(
        "*",
        F.when(F.col("t_value").isNotNull(), t_two_sided(F.col("t_value"), F.col("df_residual"))).alias("p_value"),
        F.when(F.col("f_value").isNotNull(), f_upper(F.col("f_value"), F.col("terms"), F.col("df_residual"))).alias("f_p_value"),
    )
    return table.select(
        *by, "term", "estimate", "std_error", "t_value", "p_value", "n", "df_residual", "r2", "r2_adjusted",
        "residual_error", "f_value", "dropped_terms", "f_p_value",
    )


def _attach(rows: DataFrame, models: DataFrame, by: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Rows with their group's model as ``_m``. Models are repeated for every salt, so that a large group is spread."""
    if not by:
        return rows.withColumn("_m", models.select(F.struct("*")).scalar())
    side = models.select(*[F.col(key).alias(f"_m_{key}") for key in by], F.struct("*").alias("_m"))
    side = side.withColumn("_m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    test = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_m_{key}")) for key in by])
    salted = rows.withColumn("_salt", salt)
    return salted.join(side, test & (F.col("_salt") == F.col("_m_salt"))).drop(*[f"_m_{key}" for key in by], "_salt", "_m_salt")


def ols_rows(
    df: DataFrame, response: str, features: Sequence[str], by: Sequence[str] = (), models: DataFrame | None = None
) -> DataFrame:
    """The rows without a missing value, with ``fitted``, ``residual`` and ``leverage`` under their group's model.

    ``models`` is a table of ``model`` for the same response and features; by default that of the rows themselves. The
    model goes to the rows as one value (or, per group, by a salted join); rows stay where they are.
    """
    kept = _kept(response, features)
    k = len(kept)
    measured = [missing_to_null(name) for name in [response, *kept]]
    whole = df.filter(reduce(lambda a, b: a & b, [value.isNotNull() for value in measured]))
    joined = _attach(whole, model(df, response, features, by) if models is None else models, by, [response, *kept])
    x = [f"_x{j}" for j in range(k)]
    measured = joined.select("*", *[F.col(name).cast("double").alias(x[j]) for j, name in enumerate(kept)])
    fitted = " + ".join(["_m.beta[0]", *[f"coalesce(_m.beta[{j + 1}], 0D) * {x[j]}" for j in range(k)]])
    leverage = f"1 / _m.n + {_form('_m.inverse', [f'{x[j]} - _m.means[{j}]' for j in range(k)])}"
    figures = measured.select("*", F.expr(fitted).alias("fitted"), F.expr(leverage).alias("leverage"))
    return figures.select(
        *df.columns, "fitted", (F.col(response).cast("double") - F.col("fitted")).alias("residual"), "leverage"
    )


def residual_summary(
    df: DataFrame,
    response: str,
    features: Sequence[str],
    by: Sequence[str] = (),
    probs: Mapping[str, float] = RESIDUAL_QUARTILES,
) -> DataFrame:
    """``min``, quartiles and ``max`` of the residuals and their number ``n``, for the whole table or per group.

    The bins of ``exact_quantiles`` span some residual standard errors, so the residuals' range need not be looked for.
    """
    models = model(df, response, features, by)
    rows = ols_rows(df, response, features, by, models)
    error = models.agg(F.max(F.sqrt(F.col("rss") / F.greatest(F.col("df_residual"), F.lit(1)))).alias("s")).scalar()
    found = exact_quantiles(rows, by, "residual", probs, (-SPREAD * error, SPREAD * error))
    return found.select(*by, "n", "min", *probs, "max")
