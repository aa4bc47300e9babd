"""Writers for rankings and plot-ready tables. Each task writes its own file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A parquet folder; partition registries by period so that later reads skip the other periods.

    With ``partition_by`` rows are gathered by those columns first, so that not every task writes a file into every
    folder; Spark splits a value that holds many rows and merges small ones.
    """
    gathered = df.hint("rebalance", *[F.col(name) for name in partition_by]) if partition_by else df
    gathered.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """A CSV folder with a header in each file, readable by spreadsheet programs."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_report(report: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every table of a report as a parquet folder of its name, and its ranking as CSV too.

    Parts share their first steps; cache ``report["enriched"]`` beforehand where those are costly.
    """
    for name, df in report.items():
        write_parquet(df, f"{path}/{name}", mode=mode)
    if "ranking" in report:
        write_csv(report["ranking"].orderBy("Ranking"), f"{path}/ranking_csv", mode=mode)
