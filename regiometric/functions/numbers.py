"""Ratios and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiometric.functions.codes import _col


def missing_to_null(column: Column | str) -> Column:
    """A measure as DOUBLE with NaN turned into NULL, so both spellings of "missing" behave alike."""
    value = _col(column).cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def ratio(numerator: Column | str, denominator: Column | str, per: float = 1.0) -> Column:
    """``numerator / denominator * per`` in DOUBLE; a zero denominator gives NULL."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double")) * F.lit(float(per))


def percent_of(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``, rounded half away from zero."""
    return F.round(F.try_divide(_col(part) * F.lit(100.0), _col(whole).cast("double")), digits)
