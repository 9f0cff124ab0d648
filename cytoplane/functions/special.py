"""Special functions in numpy: no scientific library beyond it is needed."""

from __future__ import annotations

import math

import numpy as np

gammaln = np.vectorize(math.lgamma, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])


def _asymptotic(x: np.ndarray, first, shift, tail) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(12):
        low = x < 12
        out = np.where(low, out + shift(x), out)
        x = np.where(low, x + 1, x)
    return out + first(x) + tail(x)


def digamma(x):
    return _asymptotic(x, np.log, lambda v: -1 / v, lambda v: -1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6))


def trigamma(x):
    return _asymptotic(x, lambda v: 1 / v, lambda v: 1 / v**2, lambda v: 1 / (2 * v**2) + 1 / (6 * v**3) - 1 / (30 * v**5) + 1 / (42 * v**7))


def inverse_trigamma(y: float) -> float:
    """x with trigamma(x) = y, by bisection on a log scale."""
    low, high = -18.0, 18.0
    for _ in range(120):
        mid = (low + high) / 2
        low, high = (mid, high) if float(trigamma(np.exp(mid))) > y else (low, mid)
    return math.exp((low + high) / 2)


def betainc(a, b, x):
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 1e-300, 1 - 1e-16)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - (gammaln(p) + gammaln(q) - gammaln(p + q))) / p
    out = np.clip(front * f, 0, 1)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - out, out)))


def upper_gamma(a, x):
    """Regularised upper incomplete gamma function: a series below a + 1, Lentz's continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - gammaln(a))
    term = total = 1 / a
    for k in range(1, 2000):
        term = term * np.where(x < a + 1, x, 0.0) / (a + k)
        total = total + term
        if np.all(term <= 1e-16 * total):
            break
    b, tiny = np.where(x < a + 1, a + 2, x) + 1 - a, 1e-300
    c, d = np.full(x.shape, 1 / tiny), 1 / b
    h = d.copy()
    for k in range(1, 2000):
        n = -k * (k - a)
        b = b + 2
        d = 1 / np.where(np.abs(n * d + b) < tiny, tiny, n * d + b)
        c = np.where(np.abs(b + n / c) < tiny, tiny, b + n / c)
        h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, np.clip(1 - front * total, 0, 1), np.clip(front * h, 0, 1)))


#: Denominator degrees of freedom beyond which an F value is a mean square of chi-squared.
NEARLY_INFINITE = 1e8


def f_tail(x, d1, d2):
    """P(F >= x); d2 may be infinite."""
    x = np.maximum(np.asarray(x, float), 0.0)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if d2 < NEARLY_INFINITE else upper_gamma(d1 / 2, d1 * x / 2)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value that F is under with probability p, by bisection of its logarithm."""
    low, high = -80.0, 80.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(f_tail(math.exp(mid), d1, d2)) > 1 - p else (low, mid)
    return math.exp((low + high) / 2)


def f_density(x: np.ndarray, d1: float, d2: float) -> np.ndarray:
    if d2 < NEARLY_INFINITE:
        const = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
        return np.exp(const + (d1 / 2 - 1) * np.log(x) - (d1 + d2) / 2 * np.log1p(d1 / d2 * x))
    return np.exp(d1 / 2 * math.log(d1 / 2) - math.lgamma(d1 / 2) + (d1 / 2 - 1) * np.log(x) - d1 * x / 2)


def t_two_sided(t, df):
    """P(|T| >= |t|); df may be infinite."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.where(np.isfinite(df), df, 1.0)
    return np.where(np.isfinite(df), betainc(finite / 2, 0.5, finite / (finite + t**2)), erfc(np.abs(t) / math.sqrt(2)))


def t_quantile(p: float, df):
    """Upper quantiles, p over one half, by bisection."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e7)
    for _ in range(90):
        mid = (low + high) / 2
        above = t_two_sided(mid, df) / 2 > 1 - p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def binomial_log_sf(k, n, p):
    """log P(X > k): with np and n(1 - p) over 10 the normal approximation with continuity, else the exact sum."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    out = np.zeros(k.shape)
    normal = (n * p > 10) & (n * (1 - p) > 10)
    if normal.any():
        z = ((k + 0.5 - n * p) / np.sqrt(n * p * (1 - p)))[normal] / math.sqrt(2)
        tail = erfc(z)
        # beyond the range of erfc its first asymptotic terms
        far = -(z**2) - np.log(np.maximum(z, 1) * math.sqrt(math.pi)) + np.log1p(-1 / (2 * np.maximum(z, 1) ** 2))
        out[normal] = np.where(tail > 0, np.log(np.maximum(tail, 1e-320)), far) + math.log(0.5)
    for at in zip(*np.where(~normal)):
        m, q, first = int(n[at]), float(p[at]), int(k[at]) + 1
        if first <= 0:
            continue
        if q <= 0 or first > m:
            out[at] = -np.inf
        elif q < 1:
            x = np.arange(first, m + 1)
            terms = gammaln(m + 1) - gammaln(x + 1) - gammaln(m - x + 1) + x * math.log(q) + (m - x) * math.log1p(-q)
            top = terms.max()
            out[at] = min(0.0, top + math.log(np.exp(terms - top).sum()))
    return out


def local_regression(x: np.ndarray, y: np.ndarray, span: float = 0.3, degree: int = 2, at: np.ndarray | None = None) -> np.ndarray:
    """LOESS with tricube weights over the nearest share `span` of the points."""
    at = x if at is None else at
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    k = min(len(xs), max(degree + 2, math.ceil(span * len(xs))))
    where, back = np.unique(at, return_inverse=True)
    fit = np.empty(len(where))
    for i, v in enumerate(where):
        left = int(np.clip(np.searchsorted(xs, v) - k, 0, len(xs) - k))
        right = int(np.clip(np.searchsorted(xs, v, side="right"), 0, len(xs) - k))
        starts = np.arange(left, right + 1)
        s = starts[np.argmin(np.maximum(v - xs[starts], xs[starts + k - 1] - v))]
        px, py = xs[s : s + k] - v, ys[s : s + k]
        reach = np.abs(px).max()
        w = np.clip(1 - (np.abs(px) / (reach * 1.000001)) ** 3, 0, None) ** 3 if reach > 0 else np.ones(k)
        basis = np.vander(px / (reach or 1.0), degree + 1, increasing=True) * np.sqrt(w)[:, None]
        fit[i] = np.linalg.lstsq(basis, py * np.sqrt(w), rcond=None)[0][0]
    return fit[back]
