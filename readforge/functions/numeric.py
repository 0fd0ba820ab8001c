"""Numeric helpers as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(x: Column, n: Column, z: float) -> tuple[Column, Column, Column]:
    """(low, estimate, high) of the Wilson score interval for x of n at normal quantile z."""
    p = x / n
    z2 = z * z
    mid, half, scale = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n), 1 + z2 / n
    return (mid - half) / scale, p, (mid + half) / scale


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal distribution, by bisection of the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x < 0, by the form that keeps most digits."""
    return F.when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def log1pexp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.when(x <= -37, F.exp(x)).when(x <= 18, F.log1p(F.exp(x))).when(x <= 33.3, x + F.exp(-x)).otherwise(x)


def log_add(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y))."""
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def log_subtract(x: Column, y: Column) -> Column:
    """log(exp(x) - exp(y)); an error where y is greater, for there are no negative probabilities."""
    return F.when(x >= y, F.when(x == y, F.lit(float("-inf"))).otherwise(x + log1mexp(y - x))).when(x < y, F.raise_error(F.lit("no negative probabilities")).cast("double"))


def log_mix(c: Column, x: Column, y: Column) -> Column:
    """log(c * exp(x) + (1 - c) * exp(y)): y for c of 0 or less, x for 1 or more."""
    high = F.log(c) + x + F.log1p((1 - c) / c * F.exp(y - x))
    low = F.log1p(-c) + y + F.log1p(c / (1 - c) * F.exp(x - y))
    return F.when(c <= 0, y).when(c >= 1, x).when(x >= y, high).otherwise(low)


def choose(n: Column, k: Column) -> Column:
    one = F.lit(1).cast("decimal(38,0)")
    return F.when(k == 0, one).otherwise(F.aggregate(F.sequence(F.lit(1), k.cast("int")), one, lambda a, i: F.floor(a * (n - k + i) / i).cast("decimal(38,0)")))


def library_complexity(total: Column, singles: Column, steps: int = 60) -> Column:
    """Size of a library of which `total` molecules were seen, `singles` of them once (Poisson); null where undefined.

    With a mean of x sightings each, total / singles = (exp(x) - 1) / x; solved by Newton's method from the right.
    """
    d = total / singles
    x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.log(10 * d), lambda x, _: x - (F.exp(x) - 1 - d * x) / (F.exp(x) - d))
    return F.when((singles > 0) & (total > singles), singles * F.exp(x) / x)


def log_sum(xs: Column) -> Column:
    """log of the sum of exp over an array; null for an empty one."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


#: Coefficients of the rational approximation of the normal quantile, inner and outer part.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution by a rational approximation; NaN outside [0, 1], infinite at its ends."""

    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    tail = lambda p: poly(_C, F.sqrt(-2 * F.log(p))) / poly(_D, F.sqrt(-2 * F.log(p)))
    q = p - 0.5
    inner = poly(_A, q * q) * q / poly(_B, q * q)
    return F.when((p < 0) | (p > 1), F.lit(float("nan"))).when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when(p < _LOW, tail(p)).when(p < 1 - _LOW, inner).otherwise(-tail(1 - p))


def integer(data: Column, at: int | Column, size: int, little: bool = True, signed: bool = False) -> Column:
    """The whole number in `size` bytes (1 to 8) of binary data from offset `at` on; null where the data end before.

    Unsigned numbers of 8 bytes are decimals of 20 digits, all others 64-bit numbers.
    """
    if not 1 <= size <= 8:
        raise ValueError("a number has 1 to 8 bytes")
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, at + 1, F.lit(size)))
    if little:
        pairs = F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)))
        digits = F.array_join(F.when(F.lit(size == 1), F.array(digits)).otherwise(pairs), "")
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if signed:
        whole = lambda x: F.lit(str(x)).cast("decimal(20,0)")
        value = F.when(value >= whole(1 << 8 * size - 1), value - whole(1 << 8 * size)).otherwise(value)
    value = F.when(F.length(data) >= at + size, value)
    return value if size == 8 and not signed else value.cast("bigint")
