"""Stored layouts: registries bucketed by code within periods, and reports that are replaced as a whole."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometric.functions import text_code

CODE = "cod6"
BUCKETS = 64


def write_bucketed(
    df: DataFrame, name: str, path: str, code: str, buckets: int = BUCKETS, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Stores ``df`` as table ``name`` in folder ``path``, bucketed and sorted by the first six characters of ``code``.

    The characters become the column ``cod6``. Tables with the same number of buckets join on it without a shuffle, and
    ``partition_by`` (the period) lets a read of one month skip the others. Rows are dealt by period and bucket into
    partitions of the advisory size, so a writing task is as large for a few buckets as for many; a bucket that is larger
    becomes several files. A bucket is read by one task: take so many buckets that one month of the largest fits, and
    leave the layout out where one code holds a great part of a month.
    """
    coded = df.withColumn(CODE, F.substring(text_code(code), 1, 6))
    # the bucket as the writer finds it, so that a bucket is spread over no more files than it needs
    numbered = coded.withColumn("_bucket", F.pmod(F.hash(CODE), F.lit(buckets)))
    dealt = numbered.hint("rebalance", *partition_by, "_bucket").drop("_bucket")
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(buckets, CODE).sortBy(CODE).saveAsTable(name)
    return df.sparkSession.table(name)


def attach_stored(registry: DataFrame, hierarchy: DataFrame, keep: Sequence[str] = ("cod_regsaud", "regiao_saude")) -> DataFrame:
    """Left join of two tables written by ``write_bucketed`` on their codes, without a shuffle of either."""
    side = hierarchy.select(F.col(CODE).alias("_code"), *keep)
    return registry.join(side, F.col(CODE) == F.col("_code"), "left").drop("_code")


def publish_report(report: Mapping[str, DataFrame], path: str) -> str:
    """Writes the tables of a report into a folder of their own and names them in a manifest, which is written last.

    Readers go by the newest manifest, so they see all tables of one run: a run that dies midway leaves no manifest and
    changes nothing, and a report that is run again replaces the earlier one at once. Earlier runs stay on disk.
    """
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in report.items():
        df.write.parquet(f"{path}/runs/{run}/{name}")
    session = next(iter(report.values())).sparkSession
    listed = session.createDataFrame([(run, name) for name in report], "run string, part string")
    listed.coalesce(1).write.json(f"{path}/manifests/{run}")
    return run


def read_published(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A table of the last complete run of a report."""
    manifests = spark.read.schema("run string, part string").json(f"{path}/manifests/*")
    newest = manifests.agg(F.max("run").alias("run")).first().run
    if newest is None or manifests.filter((F.col("run") == newest) & (F.col("part") == part)).isEmpty():
        raise AnalysisException(f"no complete run with {part} in {path}")
    return spark.read.parquet(f"{path}/runs/{newest}/{part}")
