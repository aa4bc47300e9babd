"""Descriptive statistics of a measure: means, medians, six-number summaries, box statistics, category order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometric.functions import category_number, missing_to_null, percent_label
from regiometric.operators.boxes import counted_box
from regiometric.operators.quantiles import RATE_DOMAIN, exact_quantiles, medians
from regiometric.operators.sketches import merged_quantiles, quantile_sketches
from regiometric.session import checked_broadcast, cut_lineage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
#: Where values are expected; ``AUTO`` is 0 to 1 for columns named as rates and the values' own range for others.
Domain = tuple[float, float] | str | None
AUTO = "auto"
SALTS = 32


def _domain(value: str, domain: Domain) -> tuple[float, float] | None:
    if domain == AUTO:
        return RATE_DOMAIN if value == "rate" or value.startswith("rate_") else None
    return domain


def group_means(df: DataFrame, by: Sequence[str], value: str, out: str = "media", strict: bool = True) -> DataFrame:
    """Mean per group. ``strict`` gives NULL to a group with a missing value, as a plain mean over NA does."""
    measure = missing_to_null(value)
    mean = F.avg(measure)
    if strict:
        mean = F.when(F.count_if(measure.isNull()) == 0, mean)
    return df.groupBy(*by).agg(mean.alias(out))


def group_medians(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str = "mediana",
    strict: bool = False,
    label: str | None = None,
    domain: Domain = AUTO,
    staged: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """Median per group, missing values left out or (``strict``) making the group's median NULL; optional % label.

    ``approximate`` takes it from a sketch in one aggregation, within ``sketches.rank_error``; exact is the default.
    """
    if approximate:
        found = merged_quantiles(quantile_sketches(df, by, value), by, {out: 0.5})
        whole = F.col("n_missing") == 0 if strict else F.lit(True)
        result = found.select(*by, F.when(whole, F.col(out)).alias(out))
    else:
        result = medians(df, by, {out: value}, strict, _domain(value, domain), staged)
    return result if label is None else result.withColumn(label, percent_label(out))


def overall(
    df: DataFrame,
    value: str,
    exclude: Column | None = None,
    strict: bool = True,
    domain: Domain = AUTO,
    staged: bool = False,
) -> DataFrame:
    """One row: ``n``, ``media`` and ``mediana`` of the whole table, without rows for which ``exclude`` holds.

    Rows where ``exclude`` is NULL (no state known) do not count as different and are left out too.
    """
    kept = df if exclude is None else df.filter(~exclude)
    stats = exact_quantiles(kept, [], value, {"mediana": 0.5}, _domain(value, domain), staged=staged)
    whole = (F.col("n_missing") == 0) if strict else F.lit(True)
    return stats.select(
        "n", F.when(whole, F.col("mean")).alias("media"), F.when(whole, F.col("mediana")).alias("mediana")
    )


def six_numbers(
    df: DataFrame, by: Sequence[str], value: str, domain: Domain = AUTO, staged: bool = False
) -> DataFrame:
    """Minimum, first quartile, median, mean, third quartile, maximum and the number of missing values per group."""
    stats = exact_quantiles(df, by, value, QUARTILES, _domain(value, domain), staged=staged)
    return stats.select(*by, "min", "q1", "median", "mean", "q3", "max", "n_missing")


def _in_view(df: DataFrame, value: str, clip: tuple[float, float] | None) -> DataFrame:
    return df if clip is None else df.filter(F.col(value).between(*clip))


def box_stats(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    clip: tuple[float, float] | None = None,
    reach: float = 1.5,
    domain: Domain = AUTO,
    staged: bool = False,
) -> DataFrame:
    """Hinges, median, whiskers and outlier count per group.

    Whiskers end at the most extreme values within ``reach`` interquartile ranges of the hinges. ``clip`` drops values
    outside an axis range beforehand, as a chart with fixed axis limits does. ``staged`` counts first and reads the rows
    once more (see ``boxes``), so that they are only scanned; the bins then span ``clip`` where it is given.
    """
    shown = _in_view(df, value, clip).select(*by, missing_to_null(value).alias("_value"))
    if staged:
        if not by:
            raise ValueError("box statistics are taken per group")
        ends = clip if domain == AUTO and clip is not None else _domain(value, domain)
        if ends is None:
            span = shown.agg(F.min("_value").alias("low"), F.max("_value").alias("high")).first()
            ends = (span.low or 0.0, span.high or 0.0)
        return counted_box(shown, by, ends, reach)
    # rows of one group and value become one
    rows = shown.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_c"))
    fenced = _fenced(rows, _hinges(df, by, value, clip, reach, domain, staged), by, staged)
    inside = F.col("_value").between(F.col("_low"), F.col("_high"))
    return fenced.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_c")).otherwise(0)).alias("n_outliers"),
    )


def box_outliers(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    clip: tuple[float, float] | None = None,
    reach: float = 1.5,
    domain: Domain = AUTO,
    staged: bool = False,
) -> DataFrame:
    """The rows whose value lies beyond the whiskers of their group."""
    rows = _in_view(df, value, clip).withColumn("_value", missing_to_null(value))
    fenced = _fenced(rows, _hinges(df, by, value, clip, reach, domain, staged), by, staged)
    return fenced.filter(~F.col("_value").between(F.col("_low"), F.col("_high"))).select(*df.columns)


def _hinges(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    clip: tuple[float, float] | None,
    reach: float,
    domain: Domain,
    staged: bool,
) -> DataFrame:
    if not by:
        raise ValueError("box statistics are taken per group")
    shown = _in_view(df, value, clip)
    spread = F.lit(reach) * (F.col("q3") - F.col("q1"))
    hinges = exact_quantiles(shown, by, value, QUARTILES, _domain(value, domain), staged=staged).select(
        *[F.col(key).alias(f"_h_{key}") for key in by],
        "n", "q1", "median", "q3",
        (F.col("q1") - spread).alias("_low"),
        (F.col("q3") + spread).alias("_high"),
    )
    return checked_broadcast(cut_lineage(hinges)) if staged else hinges


def _fenced(rows: DataFrame, hinges: DataFrame, by: Sequence[str], staged: bool) -> DataFrame:
    """Rows with the hinges and fences of their group.

    Where hinges are not broadcast, each is repeated for every salt and a row is joined by group and a salt of its
    value, so that a large group is spread.
    """
    test = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_h_{key}")) for key in by])
    if not staged:
        hinges = hinges.withColumn("_h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_value"), F.lit(SALTS)).cast("int"))
        test = test & (F.col("_salt") == F.col("_h_salt"))
    return rows.join(hinges, test).drop(*[f"_h_{key}" for key in by], "_salt", "_h_salt")


def category_order(
    df: DataFrame,
    category: str,
    value: str,
    descending: bool = True,
    out: str = "ord",
    exclude: Column | None = None,
    domain: Domain = AUTO,
    staged: bool = False,
) -> DataFrame:
    """Categories with the median of ``value`` and their 1-based position by it; equal medians go by name.

    The numbering window holds one row per category (macro-regions, states), not per region.
    """
    kept = df if exclude is None else df.filter(~exclude)
    table = medians(kept, [category], {"mediana": value}, domain=_domain(value, domain), staged=staged)
    first = F.desc_nulls_last("mediana") if descending else F.asc_nulls_last("mediana")
    return table.withColumn(out, F.row_number().over(Window.orderBy(first, F.asc_nulls_last(category))))


def with_order(df: DataFrame, order: DataFrame, category: str, out: str = "ord") -> DataFrame:
    """Rows with the position of their category."""
    side = order.select(F.col(category).alias("_category"), F.col(out))
    return df.join(side, F.col(category).eqNullSafe(F.col("_category")), "left").drop("_category")


def state_box(
    df: DataFrame,
    state: str,
    macro_region: str,
    value: str,
    numbers: Mapping[str, int],
    exclude: Column | None = None,
    clip: tuple[float, float] | None = None,
    staged: bool = False,
) -> DataFrame:
    """Box statistics per state with the state's position by macro-region number, largest number first."""
    kept = df if exclude is None else df.filter(~exclude)
    numbered = kept.withColumn("regiao_order", category_number(macro_region, numbers))
    order = category_order(numbered, state, "regiao_order", domain=(0, max(numbers.values())), staged=staged)
    return with_order(box_stats(kept, [state], value, clip, staged=staged), order, state)
