"""Statistics as column arithmetic (no native normal or t distribution in Spark SQL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmetry.constants import T_975, Z_975

# Abramowitz & Stegun 7.1.26, error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_normal_p(z: Column) -> Column:
    """P(|N(0,1)| > |z|)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def _expansion() -> tuple[float, ...]:
    """Numerators of the 26.7.5 series for the 97.5 % point, in powers of 1/df."""
    z = Z_975
    return (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t_975(df: Column) -> Column:
    """97.5 % point of Student's t: a table below 10 degrees of freedom, a series above."""
    series = F.lit(0.0)
    for g in reversed(_expansion()):
        series = series / df + F.lit(g)
    out = F.when(df < 1, F.lit(None).cast("double"))
    for i, value in enumerate(T_975, start=1):
        out = out.when(df == i, F.lit(value))
    return out.otherwise(series)


def ci95_half(sd: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a mean; null below two values."""
    return F.when(n >= 2, sd / F.sqrt(n) * t_975(n - 1))


def wilson_95(k: Column, n: Column) -> tuple[Column, Column]:
    """Limits within which the true share of ``k`` (may be fractional) in ``n`` lies: the shares x whose distance to k / n is
    1.96 standard errors, which are the roots of (n + q) x² - (2 k + q) x + k² / n with q = 1.96². (0, 1) for n = 0."""
    q = 3.8416
    size, total = n.cast("double"), 2 * k + q
    spread = F.sqrt(total * total - 4 * (size + q) * k * k / size)
    roots = [(total + sign * spread) / (2 * (size + q)) for sign in (-1, 1)]
    low, high = (F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) for x in roots)
    # At the ends one root is 0 or 1 exactly, which the square root need not hit.
    return F.when(k > 0, F.coalesce(low, F.lit(0.0))).otherwise(0.0), F.when(k < n, F.coalesce(high, F.lit(1.0))).otherwise(1.0)
