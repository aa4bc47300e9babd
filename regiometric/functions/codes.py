"""Territory, period and classification codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric import fixed


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def text_code(column: Column | str) -> Column:
    """A code as trimmed text, whatever type its source gave it; empty text counts as missing."""
    return F.nullif(F.trim(_col(column).cast("string")), F.lit(""))


def code_of(df: DataFrame, column: str) -> Column:
    """A code column of ``df`` for comparison with text codes: text as it is, other types turned into text."""
    return F.col(column) if dict(df.dtypes)[column] == "string" else text_code(column)


def numeric_code(column: Column | str) -> Column:
    """A code as a whole number, also where it is written as a decimal without a fraction (``11001.0``).

    Anything else gives NULL instead of failing the job.
    """
    text = F.trim(_col(column).cast("string"))
    return F.regexp_extract(text, r"^([+-]?[0-9]+)(?:[.]0*)?$", 1).try_cast("bigint")


def municipality_code(column: Column | str) -> Column:
    """The six-digit municipality code.

    Length is looked at first, so a seven-digit Federal District code loses its check digit and keeps the rest.
    """
    code = _col(column)
    return (
        F.when(F.length(code) == 7, F.substring(code, 1, 6))
        .when(code.startswith(fixed.FEDERAL_DISTRICT_PREFIX), F.lit(fixed.FEDERAL_DISTRICT_MUNICIPALITY))
        .otherwise(code)
    )


def classify_prefix(
    column: Column | str,
    rules: Iterable[tuple[str, str]] = fixed.BOND_RULES,
    default: str = fixed.BOND_UNKNOWN,
) -> Column:
    """Class of the first rule whose prefix the code starts with; codes without a match, or NULL, get ``default``."""
    code = _col(column)
    chain = None
    for prefix, label in rules:
        test = code.startswith(prefix)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.lit(default) if chain is None else chain.otherwise(default)


def period_equals(column: Column | str, year: int, month: int) -> Column:
    """``yyyyMM`` period test written as one equality, which parquet row-group statistics can use."""
    return _col(column) == F.lit(f"{year:04d}{month:02d}")


def period_year(column: Column | str) -> Column:
    """Year part of a ``yyyyMM`` period, as text."""
    return F.substring(_col(column), 1, 4)
