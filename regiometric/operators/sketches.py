"""Mergeable summaries: head counts and quantiles that are stored per region and month and combined later.

A sketch is a binary column, so a table of sketches is written and read like any other. Combining sketches gives what a
sketch of all rows together would have given, within the stated error, without going back to the rows. The exact
operators stay the default; these are for totals over many periods of registries that are too large to count again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric.functions import missing_to_null
from regiometric.operators.territory import attach_region

LG_ENTRIES = 12
KLL_SIZE = 400
PERIOD = "COMPETEN"


def headcount_error(lg_entries: int = LG_ENTRIES) -> float:
    """Relative standard error of a head count; counts up to two to the ``lg_entries`` are exact."""
    return 2.0 ** (-lg_entries / 2)


def rank_error(size: int = KLL_SIZE) -> float:
    """Largest error of a quantile's rank, as a share of all values, in 99 of 100 cases."""
    return 2.296 / size**0.9723


def headcount_sketches(
    registry: DataFrame,
    hierarchy: DataFrame,
    code: str = "CODUFMUN",
    person: str = "CPF_PROF",
    period: str = PERIOD,
    region: str = "cod_regsaud",
    lg_entries: int = LG_ENTRIES,
) -> DataFrame:
    """One row per region and period: ``people``, a sketch of the professionals seen there.

    Sketches are made per municipality code inside each task and joined to the hierarchy afterwards, so neither persons
    nor registry rows are shuffled, and a code that holds many rows costs no more than another.
    """
    per_code = registry.groupBy(code, period).agg(F.theta_sketch_agg(person, lg_entries).alias("_people"))
    attached = attach_region(per_code, hierarchy, code, [region])
    return attached.groupBy(region, period).agg(F.theta_union_agg("_people", lg_entries).alias("people"))


def combined_headcount(
    sketches: DataFrame, by: Sequence[str] = ("cod_regsaud",), out: str = "TOTAL_PROF", lg_entries: int = LG_ENTRIES
) -> DataFrame:
    """Distinct professionals over all rows of ``by`` (such as all months of a region), with the standard error."""
    united = sketches.groupBy(*by).agg(F.theta_union_agg("people", lg_entries).alias("_people"))
    count = F.theta_sketch_estimate("_people")
    exact = count <= 2**lg_entries
    return united.select(
        *by, count.alias(out), F.when(exact, 0.0).otherwise(F.lit(headcount_error(lg_entries))).alias("relative_error")
    )


def shared_people(
    sketches: DataFrame, pairs: DataFrame, region: str = "cod_regsaud", out: str = "n_shared", lg_entries: int = LG_ENTRIES
) -> DataFrame:
    """Professionals seen in both regions of each row of ``pairs`` (columns ``first`` and ``second``), over all periods.

    Pairs of which a region has no sketch are left out. The error is that of the larger head count of the two.
    """
    united = sketches.groupBy(region).agg(F.theta_union_agg("people", lg_entries).alias("_people"))
    one = united.select(F.col(region).alias("first"), F.col("_people").alias("_a"))
    other = united.select(F.col(region).alias("second"), F.col("_people").alias("_b"))
    joined = pairs.select("first", "second").join(one, "first").join(other, "second")
    return joined.select("first", "second", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias(out))


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = KLL_SIZE) -> DataFrame:
    """One row per group: ``values``, a sketch of the values' distribution, and how many are there and missing."""
    measure = missing_to_null(value).cast("double")
    return df.groupBy(*by).agg(
        F.kll_sketch_agg_double(measure, size).alias("values"),
        F.count(measure).alias("n"),
        F.count_if(measure.isNull()).alias("n_missing"),
    )


def merged_quantiles(
    sketches: DataFrame, by: Sequence[str], probs: Mapping[str, float], size: int = KLL_SIZE
) -> DataFrame:
    """Quantiles of larger groups out of the sketches of smaller ones: ``by``, ``n``, ``n_missing``, one column per probability.

    A quantile is a value whose rank is within ``rank_error`` of the wanted one; values are not interpolated. A group
    without values has NULL.
    """
    held = F.when(F.col("n") > 0, F.col("values"))
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double(held, size).alias("_values"), F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing")
    )

    def quantile(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_values", F.lit(float(p))))

    return merged.select(*by, "n", "n_missing", *[quantile(p).alias(name) for name, p in probs.items()])
