"""Linear models of log counts with precision weights and moderated variances (Law et al. 2014; Smyth 2004), in numpy.

Rows are genes, columns samples."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .special import digamma, f_density, f_quantile, f_tail, inverse_trigamma, t_quantile, t_two_sided, trigamma


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.5, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Robust local lines (Cleveland 1979): sorted x and the fit there."""
    at, values = lowess_line(x, y, span, rounds)
    return np.sort(x, kind="stable"), np.interp(np.sort(x, kind="stable"), at, values)


def lowess_line(x: np.ndarray, y: np.ndarray, span: float = 0.5, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The same as the points between which the fit is straight."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    k = max(2, int(span * n + 1e-9))
    robust, fit = np.ones(n), np.zeros(n)
    # points a hundredth of the range apart are joined by straight lines
    gap = 0.01 * (x[-1] - x[0])
    anchors = [0]
    for i in range(1, n):
        if x[i] - x[anchors[-1]] > gap or i == n - 1:
            anchors.append(i)
    anchors = np.unique(anchors)
    for step in range(rounds + 1):
        values = []
        for i in anchors:
            lo = int(np.clip(i - k + 1, 0, n - k))
            best = min(range(lo, min(i, n - k) + 1), key=lambda s: max(x[i] - x[s], x[s + k - 1] - x[i])) if lo < min(i, n - k) else lo
            h = max(x[i] - x[best], x[best + k - 1] - x[i])
            a, b = np.searchsorted(x, x[i] - h), np.searchsorted(x, x[i] + h, side="right")
            d = np.abs(x[a:b] - x[i])
            w = np.where(d <= 0.001 * h, 1.0, np.clip(1 - (d / (h or 1.0)) ** 3, 0, None) ** 3) * robust[a:b]
            total = w.sum()
            if total <= 0:
                values.append(y[i])
                continue
            w = w / total
            mean = (w * x[a:b]).sum()
            spread = (w * (x[a:b] - mean) ** 2).sum()
            slope = (w * (x[a:b] - mean) * y[a:b]).sum() / spread if np.sqrt(spread) > 0.001 * (x[-1] - x[0]) else 0.0
            values.append((w * y[a:b]).sum() + slope * (x[i] - mean))
        fit = np.interp(x, x[anchors], values)
        if step < rounds:
            left = np.abs(y - fit)
            scale = 6 * np.median(left)
            if scale < 1e-7 * left.mean():
                break
            robust = np.clip(1 - (left / scale) ** 2, 0, None) ** 2
            robust[left <= 0.001 * scale] = 1.0
    return x[anchors], np.array(values)


def log_counts(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.log2((counts + 0.5) / (sizes + 1) * 1e6)


def voom_scatter(counts: np.ndarray, design: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean log counts and roots of residual standard deviations of each gene, and whether it has counts."""
    y = log_counts(counts, sizes)
    left = y - (design @ np.linalg.lstsq(design, y.T, rcond=None)[0]).T
    sd = np.sqrt((left**2).sum(1) / (counts.shape[1] - np.linalg.matrix_rank(design)))
    return y.mean(1) + np.log2(sizes + 1).mean() - np.log2(1e6), np.sqrt(sd), counts.sum(1) > 0


def voom_weights(counts: np.ndarray, design: np.ndarray, sizes: np.ndarray, line_x: np.ndarray, line_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 counts per million and their precision weights, by the line of roots of standard deviations."""
    y = log_counts(counts, sizes)
    fitted = (design @ np.linalg.lstsq(design, y.T, rcond=None)[0]).T
    return y, 1 / np.interp(np.log2(2**fitted * 1e-6 * (sizes + 1)), line_x, line_y) ** 4


def voom(counts: np.ndarray, design: np.ndarray, sizes: np.ndarray, span: float = 0.5) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """log2 counts per million, their precision weights, and the points and line of the mean-variance trend."""
    sx, sy, seen = voom_scatter(counts, design, sizes)
    line = lowess_line(sx[seen], sy[seen], span)
    points = pd.DataFrame({"xy_x": sx[seen], "xy_y": sy[seen]}).sort_values("xy_x", kind="stable").reset_index(drop=True)
    return *voom_weights(counts, design, sizes, *line), points.assign(line_x=points.xy_x, line_y=np.interp(points.xy_x, *line))


def independent(design: np.ndarray) -> list[int]:
    """Columns that add to the rank, from the left."""
    keep: list[int] = []
    for k in range(design.shape[1]):
        if np.linalg.matrix_rank(design[:, [*keep, k]]) > len(keep):
            keep.append(k)
    return keep


def voom_by_group(counts: np.ndarray, groups: np.ndarray, design: np.ndarray, sizes: np.ndarray, span: float = 0.5) -> tuple[np.ndarray, np.ndarray, dict]:
    """voom for the samples of each group by itself, with what of the design the group can bear."""
    y, weights, points = np.empty(counts.shape), np.empty(counts.shape), {}
    for g in dict.fromkeys(groups.tolist()):
        at = np.flatnonzero(groups == g)
        part = design[at][:, independent(design[at])]
        if part.shape[1] >= len(at):
            part = np.ones((len(at), 1))
        y[:, at], weights[:, at], points[g] = voom(counts[:, at], part, sizes[at], span)
    return y, weights, points


def fit(y: np.ndarray, weights: np.ndarray, design: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted least squares of each gene."""
    genes, p = len(y), design.shape[1]
    xtwx = np.einsum("gs,si,sj->gij", weights, design, design)
    cov = np.linalg.inv(xtwx)
    beta = np.einsum("gij,gs,sj->gi", cov, weights * y, design)
    left = y - beta @ design.T
    df = np.full(genes, y.shape[1] - p, float)
    return {"beta": beta, "cov": cov, "unscaled": np.sqrt(np.einsum("gii->gi", cov)), "s2": (weights * left**2).sum(1) / df, "df": df, "mean": y.mean(1)}


def contrast(model: dict[str, np.ndarray], c: np.ndarray) -> dict[str, np.ndarray]:
    """The model in terms of contrasts, columns of c."""
    return model | {"beta": model["beta"] @ c, "unscaled": np.sqrt(np.einsum("ik,gij,jk->gk", c, model["cov"], c))}


def log_moments(s2: np.ndarray, df: np.ndarray) -> tuple[float, float]:
    """Degrees of freedom and scale of a scaled F that has the mean and the variance of log s2 (Smyth 2004)."""
    e = np.log(s2) - digamma(df / 2) + np.log(df / 2)
    spread = e.var(ddof=1) - trigamma(df / 2).mean() if len(e) > 1 else 0.0
    if spread <= 0:
        return np.inf, float(np.exp(e.mean()))
    prior = 2 * inverse_trigamma(float(spread))
    return prior, float(np.exp(e.mean() + digamma(prior / 2) - np.log(prior / 2)))


def winsorised_moments(df1: float, df2: float, tails: tuple[float, float], nodes: int = 128) -> tuple[float, float]:
    """Mean and variance of log F with its low and high tail drawn in to their quantiles, by Gauss's quadrature over
    F / (1 + F)."""
    low, high = f_quantile(tails[0], df1, df2), f_quantile(1 - tails[1], df1, df2)
    x, w = np.polynomial.legendre.leggauss(nodes)
    a, b = low / (1 + low), high / (1 + high)
    u, w = a + (b - a) * (x + 1) / 2, w * (b - a) / 2
    f = u / (1 - u)
    mass, z, ends, p = w * f_density(f, df1, df2) / (1 - u) ** 2, np.log(f), np.log([low, high]), np.array(tails)
    mean = float((mass * z).sum() + (p * ends).sum())
    return mean, float((mass * (z - mean) ** 2).sum() + (p * (ends - mean) ** 2).sum())


def robust_prior(s2: np.ndarray, df: float, tails: tuple[float, float] = (0.05, 0.1)) -> tuple[np.ndarray, float]:
    """Prior degrees of freedom of each gene and the scale, when some genes vary far more than the rest (Phipson et al.
    2016). Log variances with their tails drawn in are compared with a scaled F treated alike: the variance gives the
    prior degrees of freedom, the mean the scale. A gene further out than its rank among all lets expect is an outlier
    with some probability, and its degrees of freedom lie between the prior's and those that would make the farthest gene
    an ordinary one."""
    n = len(s2)
    plain, scale = log_moments(s2, np.full(n, df))
    if n < 3 or all(t < 1 / n for t in tails):
        return np.full(n, plain), scale
    z = np.log(s2)
    cut = int(tails[1] * n)
    centre = np.sort(z)[cut : n - cut].mean()
    drawn = np.clip(z - centre, *np.quantile(z - centre, [tails[0], 1 - tails[1]]))
    mean, var = drawn.mean(), drawn.var(ddof=1)
    excess = lambda d2: np.log(var / winsorised_moments(df, d2, tails)[1])
    prior = np.inf
    if excess(np.inf) > 0:
        if not np.isfinite(plain):
            return np.full(n, plain), scale
        # x = d2 / (1 + d2) from that of the plain fit, which outliers make too low, up to one
        low, high = plain / (1 + plain), 1.0
        if excess(plain) >= 0:
            high = low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid / (1 - mid) if mid < 1 else np.inf) < 0 else (low, mid)
        prior = plain if excess(plain) >= 0 else low / (1 - low)
    scale = float(np.exp(centre + mean - winsorised_moments(df, prior, tails)[0]))
    ratio = s2 / scale
    tail = f_tail(ratio, df, prior)
    rank = pd.Series(ratio).rank().to_numpy()
    ordinary = np.minimum(tail / ((n - rank + 0.5) / n), 1)
    each = np.full(n, prior)
    if (ordinary < 1).any():
        if np.isfinite(prior):
            far = 0.0
            if tail.min() > 0:
                far = np.log(0.5) / np.log(tail.min()) * prior
                far *= np.log(0.5) / np.log(float(f_tail(ratio.max(), df, far)))
            each = ordinary * prior + (1 - ordinary) * far
        else:
            each = np.where(ordinary < 1, ordinary * n * df, np.inf)
        order = np.argsort(tail, kind="stable")
        ranked = each[order]
        if np.isfinite(prior):
            # the lowest mean of the first genes holds for all of these, and degrees never fall from there on
            running = np.cumsum(ranked) / np.arange(1, n + 1)
            least = int(running.argmin())
            ranked[: least + 1] = running[least]
        each[order] = np.maximum.accumulate(ranked)
    return each, scale


def moderate(model: dict[str, np.ndarray], robust: bool = False) -> dict[str, np.ndarray]:
    """Variances drawn towards a common prior, whose scale and degrees of freedom fit the spread of all genes; robust:
    with degrees of freedom of each gene's own, see robust_prior."""
    s2, df = np.maximum(model["s2"], (1e-12 if robust else 1e-5) * np.median(model["s2"])), model["df"]
    if robust:
        each, scale = robust_prior(s2, float(df[0]))
    else:
        prior, scale = log_moments(s2, df)
        each = np.full(len(s2), prior)
    finite = np.where(np.isfinite(each), each, 0)
    post = np.where(np.isfinite(each), (finite * scale + df * model["s2"]) / (finite + df), scale)
    total = np.minimum(df + each, df.sum())
    t = model["beta"] / model["unscaled"] / np.sqrt(post)[:, None]
    se = np.sqrt(post)[:, None] * model["unscaled"]
    half = se * t_quantile(0.975, total)[:, None]
    return {"logFC": model["beta"], "SE": se, "LCI": model["beta"] - half, "UCI": model["beta"] + half, "AveExpr": model["mean"], "p": t_two_sided(t, total[:, None]), "t": t, "s2_prior": scale, "df_prior": each}


def residuals(y: np.ndarray, design: np.ndarray) -> np.ndarray:
    """What a least-squares fit of samples x genes on the design leaves; a rank-deficient design raises ValueError."""
    if np.linalg.matrix_rank(design) < design.shape[1]:
        raise ValueError("the design is rank-deficient")
    return y - design @ np.linalg.lstsq(design, y, rcond=None)[0]


__all__ = ["contrast", "fit", "lowess", "moderate", "residuals", "robust_prior", "voom", "voom_by_group"]
