"""Table readers. Codes become text here, once, so that joins further on compare like with like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from regiometric.functions import numeric_code, text_code
from regiometric.sources import schemas


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """A parquet table; column choice and filters further on reach the scan.

    Give the ``schema`` of tables partitioned by a code: without it Spark takes folder names like ``202201`` for numbers.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def _csv_text(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def _typed(field: StructField) -> Column:
    return F.col(f"`{field.name}`").try_cast(field.dataType)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """The columns of ``schema`` from a delimited table with a header, surrounding blanks trimmed.

    Columns are found by name, in any order, and further ones are ignored. Types are those given, never inferred, and
    malformed numbers become NULL. Spreadsheets are read in this form.
    """
    fields = StructType.fromDDL(schema).fields
    return _csv_text(spark, path, sep).select(*[_typed(field).alias(field.name) for field in fields])


def observed(df: DataFrame, schema: str, observation: Observation) -> DataFrame:
    """Text columns as the types of ``schema``, with what was refused counted on the way.

    When the result has been computed once, ``observation`` holds ``n_rows`` and, by the number of the column,
    ``missing_…`` and ``malformed_…``: how many were NULL and how many could not be read. Nothing is scanned for them.
    """
    fields = StructType.fromDDL(schema).fields
    counts = [F.count(F.lit(1)).alias("n_rows")]
    for i, field in enumerate(fields):
        given = F.col(f"`{field.name}`")
        counts += [
            F.count_if(given.isNull()).alias(f"missing_{i}"),
            F.count_if(given.isNotNull() & _typed(field).isNull()).alias(f"malformed_{i}"),
        ]
    return df.observe(observation, *counts).select(*[_typed(field).alias(field.name) for field in fields])


def load_csv(spark: SparkSession, path: str, schema: str, target: str, sep: str = ",") -> DataFrame:
    """Loads a delimited table into the parquet folder ``target`` in one pass, and returns what was refused in it.

    One row per column: ``column``, ``n_rows``, ``n_missing``, ``n_malformed``. Malformed values are NULL in the folder.
    """
    fields = StructType.fromDDL(schema).fields
    seen = Observation("load")
    text = _csv_text(spark, path, sep).select(*[F.col(f"`{field.name}`") for field in fields])
    observed(text, schema, seen).write.mode("overwrite").parquet(target)
    found = seen.get
    rows = [
        (field.name, found["n_rows"], found[f"missing_{i}"], found[f"malformed_{i}"]) for i, field in enumerate(fields)
    ]
    return spark.createDataFrame(rows, "`column` string, n_rows bigint, n_missing bigint, n_malformed bigint")


def read_rates_csv(spark: SparkSession, path: str, value: str = "rate", key: str = "regiao_saude") -> DataFrame:
    """An exported rate table (``;`` between fields) without its unnamed index column.

    ``value`` and ``key`` are the file's own names of the rate and of the region; the result has the schema ``RATES``.
    """
    rates = read_csv(spark, path, f"`{key}` string, `{value}` double", sep=";")
    return rates.withColumnsRenamed({key: "regiao_saude", value: "rate"})


def read_jdbc(spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The result of a query pushed to a database as a derived table.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in ``options`` to read it in
    parallel; without them one task reads it.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, query, options)).load()


def jdbc_options(url: str, query: str, options: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of the JDBC source for a query; the source's ``query`` option would rule out a parallel read."""
    return {"url": url, "dbtable": f"({query}) source", **(options or {})}


def with_text_codes(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Code columns as trimmed text, whatever type they came in."""
    return df.withColumns({code: text_code(code) for code in codes})


def rejected_codes(df: DataFrame, code: str) -> DataFrame:
    """One row: how many codes are missing and how many are not whole numbers."""
    text = text_code(code)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(text.isNull()).alias("n_missing"),
        F.count_if(text.isNotNull() & numeric_code(text).isNull()).alias("n_malformed"),
    )
