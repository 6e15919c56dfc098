"""Tail probabilities for result tables (one row per variable, group or term)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1 - front * beta_fraction(b, a, 1 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = value = 1 / s
        k = s
        while abs(term) > abs(value) * 1e-17:
            k += 1
            term *= x / k
            value += term
        return 1 - front * value
    b = x + 1 - s
    c, d = 1e300, 1 / b
    value = d
    for i in range(1, 2000):
        step = -i * (i - s)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def missing(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def student_two_sided(t: float, df: float) -> float | None:
    if missing(t, df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    if df > 1e5:
        # Normal expansion (Hill 1970); the fraction would need many terms here.
        a = df - 0.5
        b = 48 * a * a
        z = math.sqrt(a * math.log1p(t * t / df))
        tail = (((4 * z * z + 33) * z * z + 240) * z * z + 855) * z / (10 * b * (b + 0.8 * z**4 + 100))
        return math.erfc((z + (z**3 + 3 * z) / b - tail) / math.sqrt(2))
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def fisher_upper(f: float, df1: float, df2: float) -> float | None:
    if missing(f, df1, df2) or df1 <= 0 or df2 <= 0:
        return None
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if math.isfinite(f) else 0.0


def chi2_upper(x: float, df: float) -> float | None:
    if missing(x, df) or df <= 0:
        return None
    return gamma_upper(df / 2, x / 2)


def normal_upper(z: float) -> float | None:
    return None if missing(z) else math.erfc(z / math.sqrt(2)) / 2


def normal_two_sided(z: float) -> float | None:
    return None if missing(z) else math.erfc(abs(z) / math.sqrt(2))


def student_quantile(p: float, df: float) -> float:
    """Upper point t with P(T <= t) = p, p > 1/2, by bisection."""
    low, high = 0.0, 1.0
    while student_two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if student_two_sided(middle, df) > 2 * (1 - p):
            low = middle
        else:
            high = middle
    return (low + high) / 2


def by_row(function, *columns) -> Column:
    """One of the functions above on the rows of a small result table."""

    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series)], dtype="float64")

    return F.pandas_udf(batch, T.DoubleType())(*columns)


def student_p(t, df) -> Column:
    return by_row(student_two_sided, t, df)


def fisher_p(f, df1, df2) -> Column:
    return by_row(fisher_upper, f, df1, df2)


def chi2_p(x, df) -> Column:
    return by_row(chi2_upper, x, df)


def normal_upper_p(z) -> Column:
    return by_row(normal_upper, z)


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal, also far out in the lower tail."""
    return 0.5 * np.fromiter((math.erfc(v) for v in -np.asarray(x, float) / math.sqrt(2)), float, len(x))
