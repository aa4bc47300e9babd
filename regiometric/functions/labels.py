"""Names, label clean-up and annotation text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions.codes import _col


def recode(column: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace values found in ``mapping``; all others, NULL included, stay as they are."""
    lookup = F.create_map(*[F.lit(item) for item in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(lookup, _col(column)), _col(column))


def category_number(column: Column | str, numbers: Mapping[str, int] = fixed.MACRO_REGION_ORDER) -> Column:
    """Order number of a category; categories without one get NULL."""
    lookup = F.create_map(*[F.lit(item) for item in chain.from_iterable(numbers.items())])
    return F.try_element_at(lookup, _col(column))


def strip_lead(column: Column | str, prefix: str = fixed.MACRO_REGION_PREFIX) -> Column:
    """Remove ``prefix`` where the text begins with it, once."""
    return F.regexp_replace(_col(column), f"^{re.escape(prefix)}", "")


def strip_all(column: Column | str, word: str = fixed.MACRO_REGION_PREFIX.strip()) -> Column:
    """Remove every occurrence of ``word`` and trim the rest."""
    return F.trim(F.replace(_col(column), F.lit(word), F.lit("")))


def percent_label(column: Column | str) -> Column:
    """A share in [0, 1] as a whole percentage with its sign, ties to even."""
    return F.concat(F.bround(_col(column) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def _plain(column: Column, digits: int) -> Column:
    text = F.format_string(f"%.{digits}f", F.bround(column, digits))
    return F.regexp_replace(text, r"\.?0+$", "")


def p_label(column: Column | str) -> Column:
    """``p < 0.01`` below one percent, otherwise ``p = `` with three decimals and no trailing zeros."""
    p = _col(column)
    return F.when(p < 0.01, F.lit("p < 0.01")).when(p.isNotNull(), F.concat(F.lit("p = "), _plain(p, 3)))


def r_label(r: Column | str, p: Column | str) -> Column:
    """Annotation text of a correlation test."""
    return F.concat(F.lit("r = "), _plain(_col(r), 3), F.lit(" , "), p_label(p))
