"""Correlation, scores, t distribution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekin.options import MIN_VARIANCE


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r, NULL for a constant side.

    Written with covariance and deviations because ``corr`` divides by zero on
    constant input under ANSI mode.
    """
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def guarded_pearson(x: Column, y: Column) -> Column:
    """Aggregate: r, or 0 when fewer than two rows or ``y`` hardly varies."""
    flat = (F.count(y) < 2) | (F.var_samp(y) <= MIN_VARIANCE)
    return F.when(flat, F.lit(0.0)).otherwise(pearson(x, y))


def score(joinability: Column, correlation: Column, weight: float = 0.5) -> Column:
    """Rank value ``joinability^(1-w) * |r|^w``; w = 0.5 is sqrt(j * |r|)."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie between 0 and 1")
    if weight == 0.5:
        return F.sqrt(joinability * F.abs(correlation))
    return F.pow(joinability, F.lit(1.0 - weight)) * F.pow(F.abs(correlation), F.lit(weight))


def t_statistic(r: Column, n: Column) -> Column:
    """Test statistic of r with n - 2 degrees of freedom; NULL when undefined."""
    return F.when(n > 2, F.try_divide(r * F.sqrt(n - F.lit(2.0)), F.sqrt(1.0 - r * r)))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
    front = np.where((z <= 0.0) | (z >= 1.0), 0.0, front)

    def step(coefficient, c, d):
        d = 1.0 + coefficient * d
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + coefficient / c
        return np.where(np.abs(c) < tiny, tiny, c), d

    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d
    for m in range(1, 300):
        c, d = step(m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), c, d)
        total = total * c * d
        c, d = step(-(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)), c, d)
        change = c * d
        total = total * change
        if np.all(np.abs(change - 1.0) < 1e-14):
            break
    lower = front * total / p
    return np.where(swap, 1.0 - lower, lower)


def t_upper_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    half = 0.5 * incomplete_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0.0, half, 1.0 - half)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2.0
        if 1.0 - float(t_upper_tail(np.array(middle), np.array(df))) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _gamma_ratio(z: Column) -> Column:
    """Gamma(z + 1/2) / Gamma(z), by its series twenty places further on."""
    far = z + F.lit(20.0)
    series = F.lit(0.0)
    # Coefficients of the asymptotic series in 1/z, the highest power first.
    for c in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        series = series / far + F.lit(c)
    near = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(1.0), lambda f, k: f * (z + k) / (z + k + F.lit(0.5)))
    return near * F.sqrt(far) * series


def _two_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|): the regularized incomplete beta function at df / (df + t^2), by its continued fraction."""
    a, ratio = df / F.lit(2.0), t * t / df
    x, rest = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    swap = x > (a + 1.0) / (a + 2.5)
    half = F.lit(0.5)
    given = F.struct(
        F.when(swap, half).otherwise(a).alias("p"), F.when(swap, a).otherwise(half).alias("q"), F.when(swap, rest).otherwise(x).alias("z")
    )
    tiny = F.lit(1e-300)

    def fraction(g: Column) -> Column:
        p, q, z = g["p"], g["q"], g["z"]
        first = 1.0 / (1.0 - (p + q) * z / (p + 1.0))

        def step(state: Column, j: Column) -> Column:
            m = F.floor(j / 2).cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            k = F.when(j % 2 == 0, even).otherwise(odd)
            below = 1.0 + k * state["d"]
            c = 1.0 + k / F.when(F.abs(state["c"]) < tiny, tiny).otherwise(state["c"])
            d = 1.0 / F.when(F.abs(below) < tiny, tiny).otherwise(below)
            return F.struct(c.alias("c"), d.alias("d"), (state["total"] * c * d).alias("total"))

        # The number of steps to full precision grows with the root of df.
        steps = F.sequence(F.lit(2), (F.lit(100) + 6 * F.ceil(F.sqrt(F.greatest(p, q)))).cast("int"))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("total"))
        return F.aggregate(steps, start, step, lambda state: state["total"]) / p

    total = F.element_at(F.transform(F.array(given), fraction), 1)
    front = F.exp(F.lit(0.5) * F.log(rest) - a * F.log1p(ratio)) * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))
    tail = F.when(swap, 1.0 - front * total).otherwise(front * total)
    return F.when(rest <= 0.0, 1.0).when(ratio > 1e300, 0.0).otherwise(tail)


def two_sided_p(r: Column, t: Column, n: Column) -> Column:
    """Two-sided p of a correlation; a perfect one has p = 0. NULL without r or below three rows."""
    p = F.when(F.abs(r) >= 1.0 - 1e-15, 0.0).otherwise(_two_tails(F.coalesce(t, F.lit(0.0)), n.cast("double") - 2.0))
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), p)


def one_sided_p(t: Column, df: Column) -> Column:
    """P(T > t) with ``df`` degrees of freedom."""
    half = F.lit(0.5) * _two_tails(t, df)
    return F.when((df > 0) & t.isNotNull(), F.when(t >= 0, half).otherwise(1.0 - half))
