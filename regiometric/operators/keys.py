"""Key quality: joins by region code multiply rows where a side repeats its key, so the key is checked, not deduped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count. Only keys and counts are shuffled."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def key_report(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per table: rows, distinct keys, repeated keys, rows with a NULL key."""
    parts = []
    for name, df in tables.items():
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
                F.count(key).alias("n_keys"),
                F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("n_repeated"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_null"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def require_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Return ``df`` unchanged, or fail naming a repeated key. Runs a job."""
    repeated = duplicate_keys(df, keys).dropna(subset=list(keys)).head(1)
    if repeated:
        raise ValueError(f"{name}: key {tuple(keys)} repeats, e.g. {repeated[0].asDict()}")
    return df


def unique_or_error(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, which fails where it is computed if a key other than NULL is held by several rows.

    Rows are counted per key in the plan itself, on the partitioning that a join on the key needs anyway; no job runs here.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(key))
    text = F.concat(F.lit(f"{name}: {key} repeats, e.g. "), F.col(key).cast("string"))
    error = F.raise_error(text).cast(df.schema[key].dataType)
    checked = F.when((F.col("_rows_of_key") > 1) & F.col(key).isNotNull(), error).otherwise(F.col(key))
    return df.withColumn("_rows_of_key", rows).withColumn(key, checked).drop("_rows_of_key")
