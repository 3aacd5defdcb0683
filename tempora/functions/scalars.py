"""Scalar functions as column expressions; a domain error is null, or an error with strict=True."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _guard(ok: Column, value: Column, strict: bool, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("double")) if strict else F.when(ok, value)


def safe_log(x: Column, strict: bool = False) -> Column:
    return _guard(x > 0, F.ln(x), strict, "logarithm of a number that is not positive")


def safe_sqrt(x: Column, strict: bool = False) -> Column:
    return _guard(x >= 0, F.sqrt(x), strict, "root of a negative number")


def percentage_change(old: Column, new: Column) -> Column:
    """(new - old) / |old|; from 0 it is 0 to 0 and infinite to anything else."""
    return F.when(old == 0, F.when(new == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(new - old, F.abs(old)))


def log_return(a: Column, b: Column, strict: bool = False) -> Column:
    return _guard((a > 0) & (b > 0), F.ln(F.try_divide(b, a)), strict, "prices must be positive")


def cagr(begin: Column, end: Column, years: Column) -> Column:
    return F.when((begin > 0) & (end > 0) & (years > 0), F.pow(F.try_divide(end, begin), F.try_divide(F.lit(1.0), years)) - 1)


def annualise_return(r: Column, periods: Column, per_year: float = 252) -> Column:
    return F.pow(1 + r, F.try_divide(F.lit(per_year), periods)) - 1


def annualise_volatility(sd: Column, per_year: float = 252) -> Column:
    return sd * per_year**0.5


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * F.try_divide(x - x0, x1 - x0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def approximately_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) < tolerance


def round_up_half(x: Column, digits: int) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def factorial(n: Column) -> Column:
    """Exact up to 20, then a floating product; null below 0."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1.0), lambda a, k: a * k)
    return F.when(n >= 0, product)


def combination(n: Column, k: Column) -> Column:
    least = F.least(k, n - k).cast("int")
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), F.lit(1.0), lambda a, i: a * (n - least + i) / i)
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(least == 0, F.lit(1.0)).otherwise(F.round(product))


def permutation(n: Column, k: Column) -> Column:
    product = F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - i))
    return F.when((k < 0) | (k > n), F.lit(0.0)).when(k == 0, F.lit(1.0)).otherwise(product)


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps; 64 are enough for the range of long."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a * b), gcd(a, b)).cast("long"), F.lit(0).cast("long"))


def half_open_range(start: Column, end: Column, step: Column) -> Column:
    """start, start + step, ... without end."""
    n = F.ceil(F.try_divide(end - start, step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step)).otherwise(F.array().cast("array<double>"))


def linspace(start: Column, end: Column, n: int) -> Column:
    if n == 1:
        return F.array(start)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / (n - 1))


def logspace(start: Column, end: Column, n: int, base: float = 10.0) -> Column:
    return F.transform(linspace(start, end, n), lambda x: F.pow(F.lit(base), x))
