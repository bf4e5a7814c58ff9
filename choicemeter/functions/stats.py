"""Distribution functions that Spark does not offer."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square_survival(statistic: float, degrees: int) -> float:
    """P(X >= statistic) for a chi-square variable: the upper regularized gamma function.

    Below the mean by the power series of the lower function, above it by the continued
    fraction of the upper one; both stop when a term no longer counts, after some
    multiple of the square root of the degrees.
    """
    if degrees < 1 or math.isnan(statistic):
        return math.nan
    a, x = degrees / 2.0, statistic / 2.0
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / (b or tiny)
    fraction, step, i = d, 0.0, 0
    while abs(step - 1.0) > 1e-16 and i < 10_000_000:
        i += 1
        weight = i * (a - i)
        b += 2.0
        d = 1.0 / ((b + weight * d) or tiny)
        c = (b + weight / c) or tiny
        step = c * d
        fraction *= step
    return min(1.0, scale * fraction)


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    """Column form, for the one row a tested set leaves behind."""
    return pd.Series([chi_square_survival(float(s), int(d)) for s, d in zip(statistic, degrees)])
