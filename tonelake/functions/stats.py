"""Statistics that neither Spark nor SQL engines have built in."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054
#: Degrees of freedom with an exact table entry; above, the series in 1/df is right to 1e-6.
TABLE_DF = 200


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def t_cdf(t: float, df: int) -> float:
    x = df / (df + t * t)
    front = math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x))
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        tail = front * _beta_fraction(df / 2, 0.5, x) / (df / 2)
    else:
        tail = 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5
    return 1 - tail / 2


@lru_cache(maxsize=4)
def t_table(p: float = 0.975, df: int = TABLE_DF) -> tuple[float, ...]:
    """Student's t quantiles for 1..df degrees of freedom, by bisection."""
    out = []
    for k in range(1, df + 1):
        low, high = 0.0, 1000.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if t_cdf(mid, k) < p else (low, mid)
        out.append(round((low + high) / 2, 9))
    return tuple(out)


def t975(df: Column) -> Column:
    """The 0.975 quantile for a column of degrees of freedom; null below 1."""
    table = F.array(*(F.lit(v) for v in t_table()))
    z = Z975
    series = F.lit(z) + F.lit((z**3 + z) / 4) / df + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df) + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (df * df * df)
    return F.when((df >= 1) & (df <= TABLE_DF), F.try_element_at(table, df.cast("int"))).when(df > TABLE_DF, series)


def standard_error(sd: Column, n: Column) -> Column:
    return F.when(n > 1, sd / F.sqrt(n))
