"""Column arithmetic with the edge cases that statistics need, and distribution functions for the driver."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_number(c: Column | str) -> Column:
    return F.floor(col(c)).cast("long")


def clean(c: Column | str) -> Column:
    """The value as a double; NaN is null."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def safe_div(a: Column | str, b: Column | str, fill: float = 0.0) -> Column:
    """a / b; `fill` where either is null or b is 0."""
    return F.coalesce(F.try_divide(clean(a), clean(b)), F.lit(float(fill)))


def at_least(c: Column | str, low: float) -> Column:
    """The value, or `low` if it is less; null stays null."""
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def exact_percentile(c: Column | str, *shares: float) -> Column:
    """Linear interpolation between order statistics; one share gives a double, several an array."""
    return F.percentile(col(c), shares[0] if len(shares) == 1 else F.array(*map(F.lit, shares)))


# -- distributions, for a handful of driver-side numbers --------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """Inverse of Student's t distribution function, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))
