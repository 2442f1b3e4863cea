"""Column expressions: shape, population and score formulas. Nulls mean missing; divisions by zero give null."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of a standard deviation, evidence and distance that two populations need.
LEAST_SIGMA, EVIDENCE, DISTANCE = 1e-3, 10.0, 2.0


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def known(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def circularity(area: Column, around: Column) -> Column:
    """4 pi area / perimeter^2 within [0, 1]; null without a perimeter."""
    return F.when(around > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 4 * pi * area / (around * around))))


def equivalent_diameter(area: Column) -> Column:
    return F.sqrt(4 * area / pi)


def axes(var_x: Column, var_y: Column, cov: Column) -> tuple[Column, Column, Column]:
    """(major, minor, eccentricity) of the ellipse with these second moments."""
    middle, spread = (var_x + var_y) / 2, F.sqrt((var_x - var_y) * (var_x - var_y) / 4 + cov * cov)
    large, small = middle + spread, F.greatest(F.lit(0.0), middle - spread)
    return 4 * F.sqrt(large), 4 * F.sqrt(small), F.when(large > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - small / large))).otherwise(0.0)


def normal_logpdf(v: Column, mean: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(LEAST_SIGMA))
    return -0.5 * F.pow((v - mean) / s, 2) - F.log(s) - 0.5 * log(2 * pi)


def one_normal_loglik(n: Column, sigma: Column, var: Column) -> Column:
    """Log-likelihood of n values under their own mean and (floored) deviation, from sums alone."""
    s = F.greatest(sigma, F.lit(LEAST_SIGMA))
    return -n * (F.log(s) + 0.5 * log(2 * pi)) - n * var / (2 * s * s)


def bic(n: Column, loglik: Column, components: int) -> Column:
    return (3 * components - 1) * F.log(n) - 2 * loglik


def ashman_d(m0: Column, m1: Column, s0: Column, s1: Column) -> Column:
    return F.sqrt(F.lit(2.0)) * F.abs(m1 - m0) / F.sqrt(s0 * s0 + s1 * s1)


def crossover(w0, w1, m0, m1, s0, s1) -> Column:
    """Where two weighted normal densities meet between their means, else the middle of the means."""
    p0, p1 = 1 / (2 * s0 * s0), 1 / (2 * s1 * s1)
    a, b = p0 - p1, 2 * (p1 * m1 - p0 * m0)
    c = p0 * m0 * m0 - p1 * m1 * m1 - F.log(w0 / s0) + F.log(w1 / s1)
    low, high, middle = F.least(m0, m1), F.greatest(m0, m1), (m0 + m1) / 2
    disc = b * b - 4 * a * c
    within = lambda r: F.when(r.between(low, high), r)
    roots = [within((-b + s * F.sqrt(disc)) / (2 * a)) for s in (1, -1)]
    flat = F.when(F.abs(b) < 1e-12, middle).otherwise(F.coalesce(within(-c / b), middle))
    return F.when(F.abs(a) < 1e-12, flat).when(disc < 0, middle).otherwise(F.coalesce(*roots, middle))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
