"""Special functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: ends of the ranges and coefficients of Cody's approximations of erf and erfc, highest power first
NEAR, MIDDLE = 0.46875, 4.0
ROOT = 1.0 / math.sqrt(math.pi)
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (
        2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
        8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
    ),
    (
        1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
        3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
    ),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
SHIFT = 12
# fixed values: Bernoulli numbers B2 to B14
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def _ratio(x: Column, top: tuple, bottom: tuple) -> Column:
    """Quotient of two polynomials, coefficients from the highest power down."""
    fold = lambda cs: functools.reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(cs[0]))
    return fold(top) / fold(bottom)


def log_erfc(x: Column) -> Column:
    """ln erfc(x) for any x, by Cody's quotients of polynomials for three ranges of |x|; NULL stays NULL."""
    value = x.cast("double")
    size = F.abs(value)
    over = 1.0 / (size * size)
    tail = F.when(size <= MIDDLE, F.ln(_ratio(size, *ERFC_MIDDLE))).otherwise(F.ln(ROOT - over * _ratio(over, *ERFC_FAR)) - F.ln(size))
    upper = tail - size * size
    near = F.log1p(-value * _ratio(value * value, *ERF_NEAR))
    wide = F.when(value > 0, upper).otherwise(math.log(2.0) + F.log1p(-0.5 * F.exp(upper)))
    return F.when(F.isnan(value), value).when(size <= NEAR, near).otherwise(wide)


def log_survival(z: Column | str) -> Column:
    """ln P(Z > z) of the standard normal law."""
    return log_erfc((F.col(z) if isinstance(z, str) else z) / math.sqrt(2.0)) - math.log(2.0)


def digamma(x: Column) -> Column:
    """Derivative of the log gamma function for x > 0: shifted up by its recurrence, then the asymptotic series."""
    value = x.cast("double")
    shifted = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, k: s + 1.0 / (value + k))
    high = value + float(SHIFT)
    tail = sum((b / (2 * k) * F.pow(high, F.lit(-2.0 * k)) for k, b in enumerate(BERNOULLI, start=1)), F.lit(0.0))
    return F.when(value > 0, F.ln(high) - 0.5 / high - tail - shifted)


def trigamma(x: Column) -> Column:
    """Second derivative of the log gamma function for x > 0."""
    value = x.cast("double")
    shifted = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, k: s + 1.0 / ((value + k) * (value + k)))
    high = value + float(SHIFT)
    tail = sum((b * F.pow(high, F.lit(-2.0 * k - 1.0)) for k, b in enumerate(BERNOULLI, start=1)), F.lit(0.0))
    return F.when(value > 0, 1.0 / high + 0.5 / (high * high) + tail + shifted)
