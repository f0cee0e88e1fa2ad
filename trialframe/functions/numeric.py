"""Column expressions with the numeric policy of the engine: NaN-skipping, guarded division, normal tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
#: Coefficients of the published Chebyshev fit of the complementary error function
#: (Numerical Recipes, erfcc), highest power of t last.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def skip_nan(x: Column) -> Column:
    """x with NaN as null, so that aggregates leave it out."""
    return F.when(~F.isnan(x), x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def away_from_zero(x: Column, eps: float = EPS) -> Column:
    """max(|x|, eps) with the sign of x + eps; exactly -eps gives 0, which try_divide turns into null."""
    return F.when(x.isNotNull(), F.greatest(F.abs(x), F.lit(eps))) * F.signum(x + eps)


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for a standard normal Z; absolute error below 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + x / 2.0)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    upper = t * F.exp(-x * x + poly) / 2.0
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def normal_tail_sql(z: str) -> str:
    """The same expression as SQL text."""
    x, t = f"(abs({z}) / sqrt(2.0e0))", f"(1.0e0 / (1.0e0 + (abs({z}) / sqrt(2.0e0)) / 2.0e0))"
    poly = repr(ERFC[-1]) + "e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    upper = f"({t} * exp(-{x} * {x} + {poly}) / 2.0e0)"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0e0 - {upper} END)"


def ms_axis(frame: Column, zero: int = 27, dt: int = 10) -> Column:
    """Milliseconds of a frame: frame `zero` is 0 ms."""
    return (frame - zero) * dt

