"""Rates, intervals and tests as Column builders."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile of 95 % intervals.
Z = 1.959963985


def py_round(c: Column, digits: int) -> Column:
    """round() as Python does it: on the binary value, ties to even, 0 to 8 digits. NaN and infinities stay.

    Scaled up, a number may come to lie on a half that it doesn't equal. The product's error, which a split factor gives exactly,
    says on which side of the half the number is.
    """
    if not 0 <= digits <= 8:
        raise ValueError("0 to 8 digits")
    # as a lambda's variable the number is worked out once, however often the formula names it
    return F.get(F.transform(F.array(c.cast("double")), lambda x: _rounded(x, digits)), F.lit(0))


def _rounded(x: Column, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    size = F.abs(x)

    def scaled(a: Column) -> Column:
        """a times the scale, as the nearest whole number; the product is below 2^52."""
        product = a * scale
        high = F.lit(134217729.0) * a - (F.lit(134217729.0) * a - a)
        error = (high * scale - product) + (a - high) * scale
        whole = F.floor(product).cast("double")
        over = product - whole
        odd = F.pmod(whole, F.lit(2.0)) == 1.0
        return F.when((over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & odd))), whole + 1.0).otherwise(whole)

    # large numbers have so few binary places that integer part and fraction can be rounded apart
    whole = F.floor(size).cast("double")
    near = F.when(size < 2.0**52 / 10.0**digits, scaled(size) / scale).when(size < 2.0**53, whole + scaled(size - whole) / scale).otherwise(size)
    return F.when(x == 0, x).when(F.isnan(x), x).when(x < 0, -near).otherwise(near)


def wilson(total: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in percent, unrounded; 0 and 0 without items."""
    n = n.cast("double")
    p, z2 = total / n, F.lit(z * z)
    denom = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / denom
    half = (F.lit(z) / denom) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half) * 100.0).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half) * 100.0).otherwise(0.0)
    return low, high


def percent(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n * 100.0).otherwise(0.0)


def against_chance(score: Column, chance: Column) -> Column:
    """Score in percent rescaled so that chance is 0 and perfect is 100, not below 0; unrounded."""
    return F.when(chance >= 1.0, 0.0).otherwise(F.greatest(F.lit(0.0), (score / 100.0 - chance) / (F.lit(1.0) - chance)) * 100.0)


def minimum_n(half_width: Column, p: float = 0.5, z: float = Z) -> Column:
    """Items for a 95 % half-width in percentage points."""
    e = half_width / 100.0
    wanted = F.ceil(F.lit(z * z * p * (1 - p)) / (e * e)).cast("bigint")
    return F.when(half_width > 0, wanted).otherwise(F.raise_error(F.lit("the half-width must be positive")).cast("bigint"))


def binomial_tail(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of discordant counts with b + c < 25, unrounded."""
    triangle = F.array(*[F.array(*[F.lit(math.comb(n, k)) for k in range(n + 1)]) for n in range(25)])
    row = F.element_at(triangle, (b + c + 1).cast("int"))
    tail = F.aggregate(F.slice(row, F.lit(1), F.least(b, c).cast("int") + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.lit(2.0) * tail / F.pow(F.lit(2.0), b + c))


# Coefficients of the rational approximations of erf and erfc by W. J. Cody, Math. Comp. 23 (1969), for arguments up to
# 0.46875, up to 4, and beyond.
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """Two polynomials, highest power first, one by the other."""
    above, below = (functools.reduce(lambda s, a: s * x + a, some[1:], F.lit(some[0])) for some in parts)
    return above / below


def erfc(c: Column) -> Column:
    """The complementary error function, within 1e-14 of its value."""
    x = c.cast("double")
    y = F.abs(x)
    # exp(-y^2) from a part of y whose square is exact
    head = F.floor(y * 16.0).cast("double") / 16.0
    bell = F.exp(-head * head) * F.exp(-(y - head) * (y + head))
    inverse = F.lit(1.0) / (y * y)
    far = bell * (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(inverse, ERFC_FAR)) / y
    tail = F.when(y <= 4.0, bell * _ratio(y, ERFC_MIDDLE)).when(y < 27.3, far).otherwise(F.when(F.isnan(y), y).otherwise(0.0))
    return F.when(y <= 0.46875, F.lit(1.0) - x * _ratio(x * x, ERF_NEAR)).when(x < 0, F.lit(2.0) - tail).otherwise(tail)


def mcnemar(b: Column, c: Column) -> Column:
    """struct<p_value, chi2, test> of discordant counts: none, exact below 25, continuity-corrected chi-square from there on."""
    n = b + c
    chi2 = F.pow(F.abs(b - c) - 1.0, F.lit(2.0)) / n
    small = F.when(n < 25, binomial_tail(F.when(n < 25, b).otherwise(0), F.when(n < 25, c).otherwise(0)))
    p = F.when(n == 0, 1.0).when(n < 25, small).otherwise(erfc(F.sqrt(F.coalesce(chi2, F.lit(0.0)) / 2.0)))
    test = F.when(n == 0, "none").when(n < 25, "exact").otherwise("chi2")
    return F.struct(p.alias("p_value"), F.when(n >= 25, chi2).alias("chi2"), test.alias("test"))
