"""Relations between measures: wide tables, densities, correlation, least squares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import missing_to_null, p_label, r_label, ratio, recode
from regiometric.functions.tails import t_two_sided
from regiometric.operators.describe import group_means
from regiometric.operators.indicators import pivot_first
from regiometric.operators.quantiles import medians
from regiometric.operators.regression import ols, ols_rows, residual_summary  # noqa: F401


def rates_wide(rates: Mapping[str, DataFrame], key: str = "regiao_saude", value: str = "rate") -> DataFrame:
    """One column per rate table, for the rows of the first table; keys other tables lack get NULL.

    A chain of left joins on one key: every table is shuffled once and the joined rows stay where they are. A key that
    a table repeats gives a row per combination. NULL keys match each other.
    """
    (first, table), *others = rates.items()
    wide = table.select(key, F.col(value).alias(first))
    for name, other in others:
        side = other.select(F.col(key).alias("_key"), F.col(value).alias(name))
        wide = wide.join(side, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return wide


def density_long(
    council: DataFrame,
    census: DataFrame,
    state_code: str = "uf_sigla",
    profession: str = "profissionais",
    count: str = "qntd_profissionais",
    state_name: str = "UF",
    people: str = "populacao",
    names: Mapping[str, str] = fixed.STATES,
) -> DataFrame:
    """Professionals per 1000 inhabitants, one row per state and profession, state codes turned into names."""
    named = council.select(recode(state_code, names).alias(state_name), profession, count)
    return named.join(census.select(state_name, people), state_name, "left").select(
        state_name, profession, ratio(count, people, 1000).alias("razao_prof_hab")
    )


def density_wide(density: DataFrame, professions: Mapping[str, str], state_name: str = "UF",
                 profession: str = "profissionais", value: str = "razao_prof_hab") -> DataFrame:
    """One row per state, one column per profession."""
    return pivot_first(density, [state_name], profession, value, professions)


def state_medians(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Medians of several rates per state; a missing rate makes the state's median NULL."""
    return medians(df, by, values, strict=True)


def medians_with_density(
    table: DataFrame, density: DataFrame, state: str, density_state: str = "UF",
    codes: Mapping[str, str] = fixed.STATE_CODES,
) -> DataFrame:
    """State medians with the state's densities; state names become codes, names without a code stay."""
    side = density.withColumnRenamed(density_state, "_state")
    joined = table.join(side, F.col(state) == F.col("_state"), "left").drop("_state")
    return joined.withColumn(state, recode(state, codes))


def density_points(
    density: DataFrame,
    rates: DataFrame,
    by: Sequence[str] = ("cod_uf", "uf", "regiao"),
    value: str = "rate",
    stat: str = "mean",
    key: str = "cod_uf",
    out: str = "mean_rate",
    density_state: tuple[str, str] = ("UF", "uf_sigla"),
    how: str = "inner",
) -> DataFrame:
    """Density table joined to the state mean (or median) of the rate: the points of the density chart.

    ``how="left"`` keeps states without a rate.
    The density table's state code column leaves under a new name (``density_state``), since Spark does not tell ``UF``
    from the rates' ``uf``.
    """
    if stat == "mean":
        table = group_means(rates, by, value, out)
    elif stat == "median":
        table = medians(rates, by, {out: value})
    else:
        raise ValueError("stat must be 'mean' or 'median'")
    return density.withColumnRenamed(*density_state).join(table, key, how)


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[missing_to_null(column).alias(column) for column in columns]).dropna()


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson ``r`` and the number ``n`` of complete pairs."""
    return _complete(df, [x, y]).agg(missing_to_null(F.corr(x, y)).alias("r"), F.count(F.lit(1)).alias("n"))


def correlation_interval(df: DataFrame, x: str, y: str, level_z: float = 1.959963984540054) -> DataFrame:
    """One row: ``r``, ``n``, degrees of freedom, t, and the confidence interval from Fisher's transformation.

    ``level_z`` is the normal quantile of the level; the default is that of 95 %. Fewer than four pairs have no interval.
    """
    r, n = F.col("r"), F.col("n")
    error = F.lit(level_z) / F.sqrt(n.cast("double") - 3)
    low, high = F.tanh(F.atanh(r) - error), F.tanh(F.atanh(r) + error)
    return correlation(df, x, y).select(
        "r",
        "n",
        (n - 2).alias("df"),
        F.when(n > 2, F.try_divide(r * F.sqrt(n.cast("double") - 2), F.sqrt(1 - r * r))).alias("t"),
        F.when(n > 3, low).alias("ci_low"),
        F.when(n > 3, high).alias("ci_high"),
    )


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """``correlation_interval`` with the two-sided p-value and the chart annotation, from one pass over the rows."""
    p = F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(t_two_sided(F.col("t"), F.col("df")))
    return correlation_interval(df, x, y).withColumn("p", F.when(F.col("n") > 2, p)).withColumns(
        {"p_text": p_label("p"), "annotation": r_label("r", "p")}
    )


def simple_line(
    df: DataFrame,
    x: str,
    y: str,
    clip_x: tuple[float, float] | None = None,
    clip_y: tuple[float, float] | None = None,
) -> DataFrame:
    """One row: slope, intercept, R² and ``n`` of the least-squares line of ``y`` on ``x``.

    Axis limits (``clip_x``, ``clip_y``) drop points before the fit, as a chart with fixed limits does.
    """
    points = _complete(df, [x, y])
    if clip_x is not None:
        points = points.filter(F.col(x).between(*clip_x))
    if clip_y is not None:
        points = points.filter(F.col(y).between(*clip_y))
    return points.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def fitted_values(df: DataFrame, x: str, line: DataFrame, out: str = "fitted") -> DataFrame:
    """Rows with the line's value at ``x``."""
    slope, intercept = line.select("slope").scalar(), line.select("intercept").scalar()
    return df.withColumn(out, intercept + slope * F.col(x))


def pair_matrix(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Correlation of every column pair over all rows and, with ``by``, within each group; long form.

    Pairs with a missing side are left out pair by pair. ``level`` tells the whole table from groups, so a NULL group
    is not mistaken for the total. One aggregation serves all pairs and levels.
    """
    pairs = list(combinations(columns, 2))
    measures = df.select(*([by] if by else []), *[missing_to_null(column).alias(column) for column in columns])
    cells = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        cells += [missing_to_null(F.corr(x, y)).alias(f"_r{i}"), F.count_if(both).alias(f"_n{i}")]
    if by is None:
        table = measures.agg(*cells).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("group"), "*")
    else:
        table = (
            measures.rollup(by)
            .agg(F.grouping(by).alias("_total"), *cells)
            .select(
                F.when(F.col("_total") == 1, "all").otherwise("group").alias("level"),
                F.col(by).alias("group"),
                *[f"_{kind}{i}" for i in range(len(pairs)) for kind in "rn"],
            )
        )
    entries = F.array(
        *[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n"))
            for i, (x, y) in enumerate(pairs)
        ]
    )
    return table.select("level", "group", F.inline(entries))


def pair_points(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Scatter points of every column pair, long form; a fixed number of rows per input row, incomplete pairs dropped."""
    entries = F.array(
        *[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("x_value"), F.col(y).alias("y_value"))
            for x, y in combinations(columns, 2)
        ]
    )
    return df.select(*keys, F.inline(entries)).dropna(subset=["x_value", "y_value"])
