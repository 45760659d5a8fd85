"""Student's t on the driver: a few scalars per report, never per data row."""

from __future__ import annotations

import math


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def two_sided_p(t: float, df: int) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p > 1/2, by bisection."""
    low, high = 0.0, 1.0
    while 1.0 - two_sided_p(high, df) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 1.0 - two_sided_p(middle, df) / 2.0 < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal for p > 1/2, by bisection."""
    low, high = 0.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 0.5 * math.erfc(-middle / math.sqrt(2.0)) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


LAST_DF = 100


def quantile_rows() -> list[tuple[int, float, float]]:
    """(df, t 97.5 %, t 80 %) for df 1..100, then the normal values as df 101."""
    rows = [(df, quantile(0.975, df), quantile(0.8, df)) for df in range(1, LAST_DF + 1)]
    return [*rows, (LAST_DF + 1, normal_quantile(0.975), normal_quantile(0.8))]


def quantile_table(spark):
    """:func:`quantile_rows` as a 101-row table to broadcast."""
    return spark.createDataFrame(quantile_rows(), "df int, t975 double, t80 double")
