"""Distribution tails as Arrow functions. Each works on whole batches of numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _stirling(z):
    """What Stirling's formula leaves of the logarithm of the gamma function; z is 10 or more."""
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)


def _front(p, q, y):
    """y^p (1 - y)^q / B(p, q), without differences of large logarithms."""
    total = p + q
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        small = np.exp(_lgamma(total) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
        # Both large: relative to the mean p / (p + q).
        big_p, big_q = np.maximum(p, 10.0), np.maximum(q, 10.0)
        both = np.exp(
            p * np.log1p((y * total - p) / p) + q * np.log1p((p - y * total) / q)
            - _stirling(big_p) - _stirling(big_q) + _stirling(big_p + big_q)
        ) * np.sqrt(p / total * q / (2 * np.pi))
        # One large: its ratio of gamma functions in closed form.
        low, high = np.minimum(p, q), np.maximum(p, q)
        wide = np.maximum(high, 10.0)
        ratio = low * np.log(total) - low + (high - 0.5) * np.log1p(low / high) + _stirling(wide + low) - _stirling(wide)
        one = np.exp(ratio - _lgamma(low) + p * np.log(y) + q * np.log1p(-y))
    return np.where(low >= 10, both, np.where(high >= 10, one, small))


def beta_inc(a, b, x):
    """Regularised incomplete beta function by its continued fraction (modified Lentz).

    The fraction settles after about the square root of the larger parameter, so it runs until every element
    has; one that does not settle within many times that raises an error.
    """
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    shape = x.shape
    a, b, x = a.ravel(), b.ravel(), x.ravel()
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    swap = xs > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - xs, xs)
    front = _front(p, q, y) / p
    tiny = 1e-300
    fraction = np.full_like(y, np.nan)
    live = np.flatnonzero(np.isfinite(p) & np.isfinite(q) & np.isfinite(y))
    p_, q_, y_ = p[live], q[live], y[live]
    c = np.ones_like(y_)
    d = 1 - (p_ + q_) * y_ / (p_ + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    most = 10_000 + 100 * math.sqrt(max([1.0, *p_, *q_]))
    m = 0
    while len(live):
        m += 1
        if m > most:
            raise ArithmeticError(f"the incomplete beta function did not settle for {len(live)} values")
        for num in (
            m * (q_ - m) * y_ / ((p_ + 2 * m - 1) * (p_ + 2 * m)),
            -(p_ + m) * (p_ + q_ + m) * y_ / ((p_ + 2 * m) * (p_ + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        settled = np.abs(c * d - 1) < 1e-15
        if settled.any():
            fraction[live[settled]] = f[settled]
            on = ~settled
            live, p_, q_, y_, c, d, f = live[on], p_[on], q_[on], y_[on], c[on], d[on], f[on]
    part = front * fraction
    out = np.where(swap, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)).reshape(shape)


def beta_quantile(q, a, b):
    """Inverse of beta_inc by bisection."""
    q, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(q, a, b))
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_inc(a, b, mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def log_choose(n, k):
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


def binomial_cdf(k, n, p):
    k, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(k, n, p))
    return np.where(k >= n, 1.0, beta_inc(np.maximum(n - k, 1e-9), k + 1, 1 - np.asarray(p, dtype=float)))


def hypergeometric_upper(k, population, marked, drawn):
    """P(X >= k). The terms are summed away from the mode, until they no longer count."""
    k, N, K, n = (np.asarray(v, dtype=float) for v in (k, population, marked, drawn))
    floor_k, top = np.maximum(0, n + K - N), np.minimum(K, n)
    mode = np.floor((n + 1) * (K + 1) / (N + 2))
    upper = k > mode
    start = np.clip(np.where(upper, k, k - 1), floor_k, top)
    term = np.exp(log_choose(K, start) + log_choose(N - K, n - start) - log_choose(N, n))
    total, x, active = term.copy(), start.copy(), np.ones(len(k), dtype=bool)
    while active.any():
        up = (K - x) * (n - x) / ((x + 1) * (N - K - n + x + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            down = x * (N - K - n + x) / ((K - x + 1) * (n - x + 1))
        ratio = np.where(upper, up, down)
        term = np.where(active, term * np.where(np.isfinite(ratio), np.maximum(ratio, 0), 0), 0.0)
        total = total + term
        x = np.where(upper, x + 1, x - 1)
        active = active & (term > total * 1e-18) & (x >= floor_k) & (x <= top)
    out = np.where(upper, total, 1 - total)
    return np.where(k <= floor_k, 1.0, np.where(k > top, 0.0, np.clip(out, 0.0, 1.0)))


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(s: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(s.to_numpy(dtype=float)) / math.sqrt(2)))

    return p_value(z)


def normal_cdf(z: Column) -> Column:
    @F.pandas_udf("double")
    def cdf(s: pd.Series) -> pd.Series:
        return pd.Series(0.5 * _erfc(-s.to_numpy(dtype=float) / math.sqrt(2)))

    return cdf(z)


def t_two_sided(t: Column, freedom: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(t: pd.Series, v: pd.Series) -> pd.Series:
        tt, vv = t.to_numpy(dtype=float), v.to_numpy(dtype=float)
        ok = np.isfinite(tt) & (vv > 0)
        out = np.where(np.isinf(tt), 0.0, np.nan)
        out[ok] = beta_inc(vv[ok] / 2, 0.5, vv[ok] / (vv[ok] + tt[ok] ** 2))
        return pd.Series(out)

    return p_value(t.cast("double"), freedom.cast("double"))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_inc(b / 2, a / 2, b / (b + a * f)))

    return p_value(f.cast("double"), d1.cast("double"), d2.cast("double"))


def hypergeometric_p(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    @F.pandas_udf("double")
    def p_value(k: pd.Series, N: pd.Series, K: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_upper(k, N, K, n))

    return p_value(*[c.cast("double") for c in (k, population, marked, drawn)])
