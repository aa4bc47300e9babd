"""Order numbers and top/bottom lists with ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometric.functions import missing_to_null
from regiometric.session import cut_lineage

_ROW_BITS = 33  # width of the row number inside monotonically_increasing_id


def _by_value(measure: Column, descending: bool) -> Column:
    return measure.desc_nulls_last() if descending else measure.asc_nulls_last()


def order_number(
    df: DataFrame, value: str, ties: Sequence[str], out: str = "Ranking", descending: bool = True
) -> DataFrame:
    """Every row with its position 1..N by ``value``; missing values have no position.

    Rows of equal value go by ``ties`` (a unique key), since Spark rows have no input order. The rows are range-sorted
    over the whole cluster on value and key, so equal values spread as well, and written once to the shared folder;
    their number is the position inside the sorted partition plus the size of the partitions before it. Runs a job.
    """
    measure = missing_to_null(value)
    slotted = cut_lineage(
        df.orderBy(_by_value(measure, descending), *[F.asc_nulls_last(key) for key in ties]).withColumn(
            "_slot", F.monotonically_increasing_id()
        )
    ).withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    # one row per sorted partition
    sizes = slotted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part").alias("_start_part"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    position = F.col("_start") + F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return (
        slotted.join(F.broadcast(starts), F.col("_part") == F.col("_start_part"))
        .withColumn(out, F.when(measure.isNotNull(), position))
        .select(*df.columns, out)
    )


def top_n(df: DataFrame, value: str, n: int = 10, descending: bool = True) -> DataFrame:
    """The ``n`` rows of largest value, and all rows equal to the last of them.

    Missing values sort last and come in only where fewer than ``n`` rows have a value. Each task keeps ``n`` values to
    find the threshold; the rows themselves are filtered in place, without a shuffle.
    """
    measure = missing_to_null(value)
    best = df.select(measure.alias("_v")).orderBy(_by_value(F.col("_v"), descending)).limit(n)
    last = F.min("_v") if descending else F.max("_v")
    threshold = best.agg(F.when(F.count("_v") == n, last)).scalar()
    reached = measure >= threshold if descending else measure <= threshold
    return df.filter(threshold.isNull() | reached)


def bottom_n(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The ``n`` rows of smallest value, and all rows equal to the last of them."""
    return top_n(df, value, n, descending=False)
