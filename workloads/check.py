"""Compare registered queries with their SQL counterparts: ``python -m workloads.check FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from regiometric import spark_session
from workloads.oracle import ORACLE
from workloads.queries import REGISTRY

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(value)) for value in row)


def compare(spark, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None where results agree, otherwise what differs first."""
    df = REGISTRY[name](spark, folder)
    expected = connection.sql(ORACLE[name])
    columns = sorted(df.columns)
    if columns != sorted(expected.columns):
        return f"columns {sorted(set(df.columns) ^ set(expected.columns))}"
    got = sorted([tuple(row[c] for c in columns) for row in df.collect()], key=_key)
    order = ", ".join(f'"{c}"' for c in columns)
    want = sorted(connection.sql(f"SELECT {order} FROM ({ORACLE[name]})").fetchall(), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    for mine, theirs in zip(got, want):
        for column, a, b in zip(columns, mine, theirs):
            if type(a) is not type(b) or (a != b and not (isinstance(a, float) and math.isnan(a) and math.isnan(b))):
                return f"{column}: {a!r} <> {b!r} in {mine} / {theirs}"
    return None


def main(folder: str, names: list[str]) -> int:
    spark = spark_session(
        "check", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failures = 0
    for name in names or list(REGISTRY):
        start = time.time()
        if name not in ORACLE:
            print(f"no SQL  {name}: {REGISTRY[name](spark, folder).count()} rows", flush=True)
            continue
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:
            problem = str(error)
        failures += problem is not None
        print(f"{'ok' if problem is None else 'DIFFERS':8s}{name} {time.time() - start:.1f}s {(problem or '')[:700]}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
