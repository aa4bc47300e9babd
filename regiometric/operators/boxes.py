"""Box statistics of tables too large to shuffle, from two passes over the rows.

The first pass counts values in narrow bins. The bins that hold the wanted ranks say within what limits the hinges lie, and
so within what limits the fences lie; every other bin is wholly inside or wholly outside and is settled by its count and
its extremes. The second pass brings the rows of the open bins, folded by value, which are divided once more in the same
way. Medians and numbers for the order of categories come out of the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometric.operators.quantiles import _bin, _holds, _join, _ranks, _running
from regiometric.session import checked_broadcast, cut_lineage

FEW_VALUES = 100_000
QUARTILES: Mapping[str, float] = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _opened(keys: Sequence[str], reach: float) -> Column:
    """Whether a bin holds a wanted rank, or may hold a fence of its group."""
    group = Window.partitionBy(*keys)

    def end(p: float, upper: int, value: str) -> Column:
        return F.max(F.when(_holds(_ranks(p, F.col("n"))[upper]), F.col(value))).over(group)

    a0, a1, b0, b1 = end(0.25, 0, "_low"), end(0.25, 1, "_high"), end(0.75, 0, "_low"), end(0.75, 1, "_high")
    most, least = F.lit(reach) * (b1 - a0), F.lit(reach) * F.greatest(b0 - a1, F.lit(0.0))
    ranks = [rank for p in QUARTILES.values() for rank in _ranks(p, F.col("n"))[:2]]
    found = reduce(lambda x, y: x | y, [_holds(rank) for rank in ranks])
    for first, last in ((a0 - most, a1 - least), (b0 + least, b1 + most)):
        found = found | ((F.col("_high") >= first) & (F.col("_low") <= last))
    return found


def _divide(rows: DataFrame, keys: Sequence[str], path: Sequence[str], reach: float) -> DataFrame:
    """Bins of ``path`` with their extremes, count, running ranks and whether they have to be opened, written once.

    ``rows`` have ``_v``, ``_c`` and, below the first level, the ``_before`` and ``n`` of the bin they come from.
    """
    carried = [F.max(name).alias(name) for name in ("_before", "n") if name in rows.columns]
    counted = rows.groupBy(*path).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *carried
    )
    if carried:
        after = F.col("_before") + _running("_n", path[:-1], F.col(path[-1]))
    else:
        after = _running("_n", keys, F.col(path[-1]))
        counted = counted.withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
    ranked = counted.withColumn("_after", after).withColumn("_before", F.col("_after") - F.col("_n"))
    return cut_lineage(ranked.withColumn("open", _opened(keys, reach)))


def counted_box(
    rows: DataFrame, by: Sequence[str], domain: tuple[float | Column, float | Column], reach: float = 1.5, levels: int = 2
) -> DataFrame:
    """``by``, ``n``, the quartiles, both whiskers and ``n_outliers`` of the values ``_value``. Runs jobs.

    Missing values do not take part; a group of missing values only has a row with ``n`` 0 and NULL for the rest. The
    rows are read twice, and only those of the few open bins leave the second pass. Open bins are divided ``levels`` times
    in all, or until they hold no more than ``FEW_VALUES`` different values.
    """
    low, high = [end if isinstance(end, Column) else F.lit(float(end)) for end in domain]
    kept = rows.select(*by, F.col("_value").alias("_v"), F.when(F.col("_value").isNull(), 0).otherwise(1).cast("long").alias("_c"))
    near = kept.withColumn("_b0", _bin(F.col("_v"), low, high))
    path, settled, hollow = [*by], [], None
    for level in range(levels):
        path = [*path, f"_b{level}"]
        bins = _divide(near, by, path, reach)
        if hollow is None:
            hollow = bins.filter(F.col("n") == 0).select(*by).distinct()
        # a bin of one value is settled only if no rank or fence lies in it, so that every piece is wholly in or out
        settled.append(bins.filter(~F.col("open") & (F.col("_n") > 0)).select(*by, "_low", "_high", "_n"))
        opened = bins.filter(F.col("open") & (F.col("_n") > 0)).select(*path, "_before", "n", "_low", "_high")
        near = _join(near.drop("_before", "n").filter(F.col("_v").isNotNull()), checked_broadcast(opened), path)
        near = near.groupBy(*path, "_v").agg(
            F.sum("_c").alias("_c"), *[F.max(name).alias(name) for name in ("_before", "n", "_low", "_high")]
        )
        if level + 1 < levels:
            near = near.withColumn(f"_b{level + 1}", _bin(F.col("_v"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
            near = cut_lineage(near)
            if near.count() <= FEW_VALUES:  # nothing to gain from dividing them
                break
    placed = near.withColumn("_after", F.col("_before") + _running("_c", path, F.col("_v")))
    placed = placed.withColumn("_before", F.col("_after") - F.col("_c"))
    ends, answers = [], []
    for name, p in QUARTILES.items():
        lower, upper, weight = _ranks(p, F.col("n"))
        ends += [F.max(F.when(_holds(rank), F.col("_v"))).alias(f"_{side}_{name}") for side, rank in (("l", lower), ("u", upper))]
        a, b = F.col(f"_l_{name}"), F.col(f"_u_{name}")
        answers.append(F.when(a == b, a).otherwise(a + weight * (b - a)).alias(name))
    spread = F.lit(reach) * (F.col("q3") - F.col("q1"))
    hinges = placed.groupBy(*by).agg(F.max("n").alias("n"), *ends).select(*by, "n", *answers).withColumns(
        {"_from": F.col("q1") - spread, "_to": F.col("q3") + spread}
    )
    pieces = near.select(*by, F.col("_v").alias("_low"), F.col("_v").alias("_high"), F.col("_c").alias("_n"))
    pieces = reduce(DataFrame.unionByName, settled, pieces)
    inside = (F.col("_low") >= F.col("_from")) & (F.col("_high") <= F.col("_to"))
    found = _join(pieces, hinges, by).groupBy(*by).agg(
        *[F.max(name).alias(name) for name in ("n", *QUARTILES)],
        F.min(F.when(inside, F.col("_low"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_high"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
    )
    names = [*QUARTILES, "whisker_low", "whisker_high"]
    empty = hollow.select(
        *by, F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(name) for name in names],
        F.lit(0).cast("long").alias("n_outliers"),
    )
    return found.unionByName(empty)
