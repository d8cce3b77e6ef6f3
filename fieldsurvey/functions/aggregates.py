"""Aggregate expressions for ``groupBy(...).agg(...)``.

All of them are partial aggregates: a few huge groups are reduced where their
rows lie and only one small buffer per group and task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldsurvey.functions.values import col, count_ratio, finite


def mean_(c: Column | str) -> Column:
    return F.avg(col(c))


def proportion(c: Column | str) -> Column:
    """Share of TRUE among the values present."""
    return F.avg(col(c).cast("double"))


def geomean(c: Column | str) -> Column:
    """Geometric mean; NULL for a group holding any value at or below zero."""
    c = col(c)
    return F.when(F.min(c) > 0, F.exp(F.avg(F.ln(c))))


def coverage(c: Column | str) -> Column:
    """Values present over all rows."""
    return count_ratio(F.count(col(c)), F.count("*"))


def representative(c: Column | str) -> Column:
    """The one value of the group; an error if the group holds several.

    For text the engine sorts its input, so apply it to distinct rows.
    """
    c = col(c)
    several = F.min(c) < F.max(c)
    return F.when(several, F.raise_error(F.lit("group has several values"))).otherwise(F.min(c))


def fit_two_term(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Least-squares ``y = c1*x + c2*x*x`` without intercept, in closed form.

    It is the line ``y/x = c1 + c2*x`` under weights ``x*x``. Its weighted moments are
    put together from moments about the mean of ``x``, which the engine merges
    without loss, so that a late start of a series costs no digits. Zeros in ``x`` have
    no weight and are left out of them. There is a fit where the rest of ``x`` varies,
    however little: no threshold decides that.
    """
    x, y = col(x), col(y)
    complete = x.isNotNull() & y.isNotNull() & (x != 0)
    x = F.when(complete, x)
    n, mean, m2 = F.count(x).cast("double"), F.avg(x), F.regr_sxx(x, x)
    # Third and fourth moments about the mean; the bounds tell whether x varies, its spread may be rounding only.
    spread = F.when((F.min(x) < F.max(x)) & (m2 > 0), m2)
    m3 = F.skewness(x) * spread * F.sqrt(spread / n)
    m4 = (F.kurtosis(x) + 3) * spread * spread / n
    weight = mean * mean * n + m2
    first = 2 * mean * m2 + m3
    second = mean * mean * m2 + 2 * mean * m3 + m4
    product = F.when(complete, x * y)
    total = F.sum(product)
    bottom = second - first * first / weight
    bottom = F.when(bottom > 0, bottom)
    c2 = (F.regr_sxy(product, x) - first * total / weight) / bottom
    return finite(total / weight - c2 * (mean + first / weight)), finite(c2)


def fit_line(y: Column | str, x: Column | str, where: Column | None = None) -> tuple[Column, Column]:
    """Intercept and slope of ``y ~ x`` over the rows that satisfy ``where``."""
    y, x = col(y), col(x)
    if where is not None:
        y = F.when(where, y)
    return finite(F.regr_intercept(y, x)), finite(F.regr_slope(y, x))


def fit_r2(y: Column | str, x: Column | str, where: Column | None = None) -> Column:
    """R squared of ``y ~ x``; NULL where ``y`` does not vary."""
    y, x = col(y), col(x)
    y = F.when(x.isNotNull() if where is None else where & x.isNotNull(), y)
    return F.when(F.min(y) < F.max(y), finite(F.regr_r2(y, x)))
