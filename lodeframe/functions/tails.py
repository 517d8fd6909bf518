"""Tail probabilities of the t, F and chi-square distributions, on aggregate rows only.

The incomplete beta and gamma functions are evaluated by continued fractions and
series, which converge in a few dozen terms.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _fraction(a: list[float] | object, b: object, n: int = 500) -> float:
    """Continued fraction with terms a(i), b(i), i from 1, by the modified Lentz method."""
    f, c, d = _TINY, _TINY, 0.0
    for i in range(1, n):
        d = b(i) + a(i) * d or _TINY
        c = b(i) + a(i) / c or _TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def term(i: int) -> float:
        if i == 1:
            return 1.0
        m = (i - 1) // 2
        if i % 2:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        m = i // 2 - 1
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(term, lambda i: 1.0)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    return front * _fraction(lambda i: 1.0 if i == 1 else -(i - 1) * (i - 1 - a), lambda i: x + 2 * i - 1 - a)


def t_tail(t: float, df: float, alternative: str = "two-sided") -> float:
    """p-value of a t statistic; infinite statistics give 0 or 1."""
    if math.isinf(t):
        both = 0.0
    else:
        both = beta_inc(df / 2, 0.5, df / (df + t * t))
    if alternative == "two-sided":
        return both
    upper = both / 2 if t > 0 else 1 - both / 2
    return upper if alternative == "greater" else 1 - upper


def f_tail(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def _column(function: object, *args: Column) -> Column:
    @F.pandas_udf("double")
    def tail(frame: pd.DataFrame) -> pd.Series:
        rows = frame.itertuples(index=False)
        return pd.Series([None if any(v is None or v != v for v in row) else function(*row) for row in rows], dtype="float64")

    return tail(F.struct(*(a.cast("double").alias(f"a{i}") for i, a in enumerate(args))))


def t_pvalue(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    return _column(lambda a, b: t_tail(a, b, alternative), t, df)


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    return _column(f_tail, f, df1, df2)


def chi2_pvalue(x: Column, df: Column) -> Column:
    return _column(chi2_tail, x, df)
