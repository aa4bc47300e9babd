"""Column functions: codes, labels and numbers."""

from regiometric.functions.codes import (
    classify_prefix,
    code_of,
    municipality_code,
    numeric_code,
    period_equals,
    period_year,
    text_code,
)
from regiometric.functions.labels import category_number, p_label, percent_label, r_label, recode, strip_all, strip_lead
from regiometric.functions.numbers import missing_to_null, percent_of, ratio

__all__ = [
    "category_number", "classify_prefix", "code_of", "missing_to_null", "municipality_code", "numeric_code", "p_label",
    "percent_label", "percent_of", "period_equals", "period_year", "r_label", "ratio", "recode", "strip_all",
    "strip_lead", "text_code",
]
