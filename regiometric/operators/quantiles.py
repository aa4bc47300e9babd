"""Exact quantiles without holding a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in the memory of one task. Here the values are first
counted in narrow value bins (combined inside each task), running totals over the bins tell which bin holds each wanted
rank, and only rows of those bins are looked at one by one. The result is the usual linear interpolation between order
statistics (position ``p * (n - 1)``), the same as ``percentile``.

The bins only steer the amount of work. ``domain`` is where values are expected (rates: 0 to 1); values outside go to
the first or last bin, and the answer stays exact for any data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometric.functions import missing_to_null
from regiometric.session import checked_broadcast, cut_lineage

BINS = 65536
RATE_DOMAIN = (0.0, 1.0)
_STATS = ("n", "n_missing", "mean", "min", "max")


def _bin(value: Column, low: Column, high: Column) -> Column:
    step = F.floor(F.try_divide(value - low, high - low) * BINS)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.coalesce(step, F.lit(0))))


def _ranks(p: float, n: Column) -> tuple[Column, Column, Column]:
    """0-based ranks on both sides of the quantile's position, and how far it lies towards the upper one."""
    position = F.lit(float(p)) * (n - 1)
    return F.floor(position), F.ceil(position), position - F.floor(position)


def _holds(rank: Column) -> Column:
    """Whether the row covers a rank: ``_before`` values come before it, ``_after`` up to its end."""
    return (rank >= F.col("_before")) & (rank < F.col("_after"))


def _holds_any(probs: Mapping[str, float]) -> Column:
    ranks = [rank for p in probs.values() for rank in _ranks(p, F.col("n"))[:2]]
    return reduce(lambda a, b: a | b, [_holds(rank) for rank in ranks])


def _running(column: str, keys: Sequence[str], order: Column) -> Column:
    window = Window.partitionBy(*keys).orderBy(order)
    return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _join(rows: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the picked bins; NULL groups match. The join key holds the bin, so a large group is spread."""
    side = picked.withColumnsRenamed({key: f"_p{key}" for key in keys})
    match = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_p{key}")) for key in keys])
    return rows.join(side, match).drop(*[f"_p{key}" for key in keys])


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    domain: tuple[float | Column, float | Column] | None = RATE_DOMAIN,
    levels: int = 2,
    staged: bool = False,
) -> DataFrame:
    """One row per group: ``by``, ``n``, ``n_missing``, ``mean``, ``min``, ``max`` and one column per probability.

    NULL and NaN are missing and do not take part; a group of missing values only has NULL statistics. An empty ``by``
    gives one row for the whole table. ``domain=None`` spans the bins between the table's own minimum and maximum; its
    ends may also be scalar columns.
    With two ``levels`` the wanted bins are divided once more between their own extremes, so that values which crowd
    into few bins, or lie outside the domain, still spread over tasks.

    ``staged`` is for tables so large that their rows should not be shuffled: the counting pass runs at once, and the
    few wanted bins are then broadcast (if they are few indeed) to the second pass over the rows. Otherwise all of it
    is one lazy plan, in which rows of one group and value are folded into one before anything is joined.
    """
    keys = list(by) or ["_all"]
    rows = df.select(*by, missing_to_null(value).alias("_v"))
    if not by:
        rows = rows.select(F.lit(0).alias("_all"), "_v")
    if domain is None:
        span = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
        low, high = span.select("low").scalar(), span.select("high").scalar()
    else:
        low, high = [end if isinstance(end, Column) else F.lit(float(end)) for end in domain]
    if staged:
        rows = rows.withColumn("_c", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    rows = rows.withColumn("_b0", F.when(F.col("_v").isNotNull(), _bin(F.col("_v"), low, high)))

    # at most BINS rows per group, and one for its missing values (bin NULL)
    counted = rows.groupBy(*keys, "_b0").agg(
        F.sum(F.when(F.col("_v").isNull(), 0).otherwise(F.col("_c"))).alias("_n"),
        F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("_missing"),
        F.sum(F.col("_v") * F.col("_c")).alias("_sum"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    group = Window.partitionBy(*keys)
    ranked = (
        counted.withColumn("_after", _running("_n", keys, F.col("_b0").asc_nulls_first()))
        .withColumns(
            {
                "_before": F.col("_after") - F.col("_n"),
                "n": F.sum("_n").over(group),
                "n_missing": F.sum("_missing").over(group),
                "_total": F.sum("_sum").over(group),
                "min": F.min("_low").over(group),
                "max": F.max("_high").over(group),
            }
        )
        .withColumn("mean", F.try_divide(F.col("_total"), F.col("n").cast("double")))
    )
    columns = [*keys, "_b0", "_before", "_low", "_high", *_STATS]
    # the bin of missing values covers no rank; a test for it here would be inferred for the rows of the join as well, and
    # keep both uses of the rows from sharing one exchange
    chosen = ranked.filter(_holds_any(probs) | (F.col("n") == 0)).select(*columns)
    if staged:
        chosen = cut_lineage(chosen)
    picked, hollow = chosen.filter(F.col("n") > 0), chosen.filter(F.col("n") == 0)

    path = [*keys, "_b0"]
    near = _join(rows, checked_broadcast(picked) if staged else picked, path)
    carried = ["_before", *_STATS]
    for level in range(1, levels):
        near = near.withColumn(f"_b{level}", _bin(F.col("_v"), F.col("_low"), F.col("_high")))
        finer = near.groupBy(*path, f"_b{level}").agg(
            F.sum("_c").alias("_n"),
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
            *[F.max(name).alias(name) for name in carried],
        )
        finer = finer.withColumn("_after", F.col("_before") + _running("_n", path, F.col(f"_b{level}")))
        finer = finer.withColumn("_before", F.col("_after") - F.col("_n")).filter(_holds_any(probs))
        path = [*path, f"_b{level}"]
        near = _join(near.drop(*carried, "_low", "_high"), finer.drop("_after", "_n"), path)

    if staged:  # repeated values folded into one row with a count, so a value held by many rows is one row here
        folded = near.groupBy(*path, "_v").agg(
            F.sum("_c").alias("_n"), *[F.max(name).alias(name) for name in carried]
        )
    else:  # they were folded in the beginning
        folded = near.select(*path, "_v", F.col("_c").alias("_n"), *carried)
    placed = folded.withColumn("_after", F.col("_before") + _running("_n", path, F.col("_v"))).withColumn(
        "_before", F.col("_after") - F.col("_n")
    )
    ends, answers = [], []
    for i, (name, p) in enumerate(probs.items()):
        lower, upper, weight = _ranks(p, F.col("n"))
        ends += [
            F.max(F.when(_holds(lower), F.col("_v"))).alias(f"_l{i}"),
            F.max(F.when(_holds(upper), F.col("_v"))).alias(f"_u{i}"),
        ]
        low_end, high_end = F.col(f"_l{i}"), F.col(f"_u{i}")
        between = F.when(low_end == high_end, low_end).otherwise(low_end + weight * (high_end - low_end))
        answers.append(between.alias(name))
    found = placed.groupBy(*keys).agg(*[F.max(name).alias(name) for name in _STATS], *ends)
    full = found.select(*keys, *_STATS, *answers)
    empty = hollow.select(*keys, *_STATS, *[F.lit(None).cast("double").alias(name) for name in probs])
    return full.unionByName(empty).select(*by, *_STATS, *probs)


def medians(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, str],
    strict: bool = False,
    domain: tuple[float, float] | None = RATE_DOMAIN,
    staged: bool = False,
) -> DataFrame:
    """Medians of one or several columns per group, ``{output: column}``.

    ``strict=False`` leaves missing values out; ``strict=True`` gives NULL to a group that has any.
    """

    def median(tall: DataFrame, out: str) -> DataFrame:
        if strict:
            tall = tall.withColumn(out, F.when(F.col("n_missing") == 0, F.col(out)))
        return tall

    if len(values) == 1:
        [(out, column)] = values.items()
        return median(exact_quantiles(df, by, column, {out: 0.5}, domain, staged=staged), out).select(*by, out)
    stacked = df.select(*by, *[missing_to_null(column).alias(out) for out, column in values.items()]).unpivot(
        list(by), list(values), "_measure", "_value"
    )
    found = exact_quantiles(stacked, [*by, "_measure"], "_value", {"_median": 0.5}, domain, staged=staged)
    tall = median(found, "_median")
    return tall.groupBy(*by).agg(
        *[F.max(F.when(F.col("_measure") == out, F.col("_median"))).alias(out) for out in values]
    )
