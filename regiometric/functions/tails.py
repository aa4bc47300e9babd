"""Tail probabilities of the t and F distributions as column expressions, without a fit or a job."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 200
_TINY = 1e-300


def _log_gamma(x: str) -> str:
    """Stirling's series at ``x`` + 7, brought back by the recurrence; for positive ``x``."""
    z = f"({x} + 7)"
    series = f"1 / (12 * {z}) - 1 / (360 * power({z}, 3)) + 1 / (1260 * power({z}, 5)) - 1 / (1680 * power({z}, 7))"
    product = " * ".join([x, *[f"({x} + {k})" for k in range(1, 7)]])
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)}D + {series} - ln({product}))"


def _safe(value: str) -> str:
    return f"if(abs({value}) < {_TINY}D, {_TINY}D, {value})"


def _fraction(s: str) -> str:
    """The continued fraction of the incomplete beta function of ``a``, ``b`` and ``x`` of a struct, from the front."""
    first = f"1 / {_safe(f'(1 - ({s}.a + {s}.b) * {s}.x / ({s}.a + 1))')}"
    m = "floor(k / 2)"  # odd k = 2m + 1 and even k = 2m take turns
    even = f"{m} * ({s}.b - {m}) * {s}.x / (({s}.a + 2 * {m} - 1) * ({s}.a + 2 * {m}))"
    odd = f"-({s}.a + {m}) * ({s}.a + {s}.b + {m}) * {s}.x / (({s}.a + 2 * {m}) * ({s}.a + 2 * {m} + 1))"
    # the term of a step, then both convergents, then their product
    pair = f"named_struct('c', {_safe('(1 + v / r.c)')}, 'd', 1 / {_safe('(1 + v * r.d)')})"
    move = f"transform(transform(array(if(k % 2 = 0, {even}, {odd})), v -> {pair}), q -> named_struct('c', q.c, 'd', q.d, 'h', r.h * q.c * q.d))[0]"
    return f"aggregate(sequence(2, {2 * STEPS}), named_struct('c', 1D, 'd', {first}, 'h', {first}), (r, k) -> {move}, r -> r.h)"


def _beta_text() -> str:
    logs = f"{_log_gamma('(s.a + s.b)')} - {_log_gamma('s.a')} - {_log_gamma('s.b')}"
    front = f"exp({logs} + s.a * ln(s.x) + s.b * ln(1 - s.x))"
    part = f"{front} * {_fraction('s')} / s.a"
    return f"s -> if(s.x <= 0, 0D, if(s.x >= 1, 1D, {part}))"


_BETA = _beta_text()


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of doubles ``a``, ``b`` > 0 and ``x`` in 0 to 1.

    Where the fraction converges slowly the other tail is taken. The text is parsed as a whole, which is much faster than
    putting it together from columns, and the numbers are bound once.
    """
    near = x < (a + 1) / (a + b + 2)
    one, other, at = (F.when(near, u).otherwise(v) for u, v in ((a, b), (b, a), (x, 1 - x)))
    given = F.array(F.struct(one.alias("a"), other.alias("b"), at.alias("x"), near.alias("near")))
    tail = F.call_function("transform", given, F.expr(f"s -> struct(transform(array(s), {_BETA})[0] AS p, s.near AS near)"))
    return F.call_function("transform", tail, F.expr("t -> if(t.near, t.p, 1 - t.p)"))[0]


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a t statistic at least as far from zero; NULL without degrees of freedom."""
    df = df.cast("double")
    tail = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when(df > 0, tail)


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """Probability of an F statistic at least as large; NULL without degrees of freedom."""
    df1, df2 = df1.cast("double"), df2.cast("double")
    tail = incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
    return F.when((df1 > 0) & (df2 > 0), tail)
