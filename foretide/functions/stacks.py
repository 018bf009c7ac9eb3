"""Dense algebra for many sites at once: every array has sites first, nothing loops over sites.

Rows that a site lacks are marked in `live` (sites x times) and count as rows of zeros. A site whose fit can't be made (too
few rows, dependent columns) gets NaN, which the plans turn into nulls; anything else that goes wrong is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from foretide.functions.kernels import EPS

Fits = tuple[np.ndarray, np.ndarray, np.ndarray]
#: A column counts as dependent where its part outside the others is a smaller share of the largest.
DEPENDENT = 1e-13


def patterns(live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of sites with the same rows: their places, and which rows those are. Most often there is one."""
    packed = np.packbits(live, axis=1)
    keys, group = np.unique(packed, axis=0, return_inverse=True)
    for g in range(len(keys)):
        places = np.flatnonzero(group.ravel() == g)
        yield places, live[places[0]]


def _factored(x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, r of each site's rows, and whether its columns are independent; r is the identity where they are not."""
    if x.shape[1] < x.shape[2]:
        x, live = (np.pad(a, ((0, 0), (0, x.shape[2] - x.shape[1]), *((0, 0),) * (a.ndim - 2))) for a in (x, live))
    q, r = np.linalg.qr(np.where(live[..., None], x, 0.0))
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    good = (live.sum(1) >= x.shape[2]) & (size.min(1) > DEPENDENT * size.max(1))
    return q, np.where(good[:, None, None], r, np.eye(x.shape[2])), good


def ols(x: np.ndarray, y: np.ndarray, live: np.ndarray, at: np.ndarray) -> Fits:
    """Least squares of y (sites x times) on x (sites x times x columns), predicted at the rows `at` (sites x columns): mean, scale, degrees of freedom."""
    y = np.where(live, y, 0.0)
    q, r, good = _factored(x, live)
    q = q[:, : x.shape[1]]
    beta = np.linalg.solve(r, np.einsum("snp,sn->sp", q, y)[..., None])[..., 0]
    inner = np.linalg.solve(np.swapaxes(r, 1, 2), at[..., None])[..., 0]
    nu = live.sum(1) - x.shape[2]
    rest = np.where(live, y - np.einsum("snp,sp->sn", x, beta), 0.0)
    with np.errstate(all="ignore"):
        sigma = np.sqrt((rest**2).sum(1) / np.where(nu > 0, nu, np.nan) * (1 + (inner**2).sum(1)))
    return np.where(good, (at * beta).sum(1), np.nan), np.where(good, sigma, np.nan), np.where(good, nu, np.nan).astype(float)


def ols_parts(x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their variances, and the residual variance; NaN where there are not more rows than columns."""
    y = np.where(live, y, 0.0)
    q, r, good = _factored(x, live)
    q = q[:, : x.shape[1]]
    beta = np.linalg.solve(r, np.einsum("snp,sn->sp", q, y)[..., None])[..., 0]
    inverse = np.linalg.inv(r)
    nu = live.sum(1) - x.shape[2]
    rest = np.where(live, y - np.einsum("snp,sp->sn", x, beta), 0.0)
    s2 = np.where(good & (nu > 0), (rest**2).sum(1) / np.maximum(nu, 1), np.nan)
    return np.where(good[:, None], beta, np.nan), s2[:, None] * (inverse**2).sum(2), s2


def golden(cost: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, steps: int = 70) -> np.ndarray:
    """Minima of many functions of one variable, each on its interval."""
    ratio = (math.sqrt(5) - 1) / 2
    low, high = low.astype(float).copy(), high.astype(float).copy()
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = cost(a), cost(b)
    for _ in range(steps):
        left = fa <= fb
        high, low = np.where(left, b, high), np.where(left, low, a)
        new = np.where(left, high - ratio * (high - low), low + ratio * (high - low))
        f = cost(new)
        a, b, fa, fb = np.where(left, new, b), np.where(left, a, new), np.where(left, f, fb), np.where(left, fa, f)
        if (high - low).max() < 1e-11:
            break
    return (low + high) / 2


def shrunk(x: np.ndarray, y: np.ndarray, live: np.ndarray, at: np.ndarray, prior: np.ndarray, free: int, scale: np.ndarray | None = None, whiten: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, penalty: float | None = None) -> Fits:
    """Tikhonov fits that pull all but the first `free` coefficients to `prior`.

    The free columns are projected out, the rest multiplied by `scale`, both sides whitened (whiten(live, columns)), and
    the penalty of each site, unless given, has the least corrected Akaike criterion.
    """
    k = x.shape[2] - free
    scale = np.ones(k) if scale is None else scale
    x = np.where(live[..., None], x, 0.0)
    r = np.where(live, y, 0.0) - x @ prior
    x1, x2 = x[:, :, :free], x[:, :, free:] * scale
    if free:
        q, upper, good = _factored(x1, live)
        own = np.linalg.solve(upper, np.swapaxes(q[:, : x.shape[1]], 1, 2))
    else:
        own, good = np.zeros((len(x), 0, x.shape[1])), np.ones(len(x), bool)
    a, b = x2 - x1 @ (own @ x2), r - (x1 @ (own @ r[..., None]))[..., 0]
    if whiten is not None:
        both = whiten(live, np.concatenate([a, b[..., None]], 2))
        a, b = both[..., :-1], both[..., -1]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    n, s2, ub = live.sum(1).astype(float), s**2, np.einsum("snk,sn->sk", u, b)
    outside = np.maximum(0.0, (b * b).sum(1) - (ub * ub).sum(1))
    good &= n > free

    def rss_at(p: np.ndarray) -> np.ndarray:
        return outside + ((p[:, None] / (s2 + p[:, None])) ** 2 * ub**2).sum(1)

    def criterion(log_p: np.ndarray) -> np.ndarray:
        p = np.exp(log_p)
        d = (s2 / (s2 + p[:, None])).sum(1)
        return n * (np.log(np.maximum(rss_at(p), 1e-300) / n) + 2 * d / (n - d - 1))

    with np.errstate(all="ignore"):
        if penalty is None:
            chosen = np.exp(golden(criterion, np.log(s[:, -1] / 1e3 + EPS), np.log(s[:, 0] * 1e3 + EPS)))
        else:
            chosen = np.full(len(x), penalty)
        gain = s / (s2 + chosen[:, None])
        z = np.einsum("skj,sk->sj", vt, gain * ub)
        beta = np.concatenate([(own @ (r[..., None] - x2 @ z[..., None]))[..., 0], scale * z], 1) + prior
        back = np.concatenate([-own @ x2, np.broadcast_to(np.diag(np.ones(k) * scale), (len(x), k, k))], 1)
        lever = np.einsum("sp,spj,skj->sk", at, back, vt) * gain
        nu = n - (s2 / (s2 + chosen[:, None])).sum(1) - free
        sigma = np.sqrt(rss_at(chosen) / np.where(nu > 0, nu, np.nan) * (1 + (lever**2).sum(1)))
    return np.where(good, (at * beta).sum(1), np.nan), np.where(good, sigma, np.nan), np.where(good, nu, np.nan)


# ---- random walks plus noise ----


def innovate(z: np.ndarray, live: np.ndarray, ahead: np.ndarray, gamma: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the innovations of columns z (sites x times x columns), and log det Q, for Q = (1 - gamma) I + gamma min(ahead, ahead').

    The walk is 0 at the target, so it is filtered from the nearest time outwards; gamma may differ from site to site.
    """
    n, _, k = z.shape
    a, p, last, logdet, total = np.zeros((n, k)), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, k, k))
    for i in np.argsort(ahead):
        on = live[:, i]
        walk = p + gamma * (ahead[i] - last)
        f = walk + (1 - gamma)
        e = np.where(on[:, None], z[:, i] - a, 0.0)
        total += e[:, :, None] * e[:, None, :] / f[:, None, None]
        logdet += np.where(on, np.log(f), 0.0)
        a = a + (walk / f)[:, None] * e
        p, last = np.where(on, walk * (1 - gamma) / f, p), np.where(on, ahead[i], last)
    return total, logdet


def normal_equations(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sums of products of columns and, last, a response: whether they can be solved, the last column's coefficient, its unit variance, and the residual sum."""
    k = total.shape[1] - 1
    with np.errstate(all="ignore"):
        size = np.sqrt(np.diagonal(total, axis1=1, axis2=2))[:, :k]
        scaled = total[:, :k, :k] / size[:, :, None] / size[:, None]
        good = np.isfinite(scaled).all((1, 2))
        scaled = np.where(good[:, None, None], scaled, np.eye(k))
        good &= np.linalg.eigvalsh(scaled)[:, 0] > DEPENDENT
        scaled = np.where(good[:, None, None], scaled, np.eye(k))
        b = total[:, :k, k] / size
        solved = np.linalg.solve(scaled, np.stack([b, np.eye(k)[-1:].repeat(len(total), 0)], -1))
        rss = np.maximum(total[:, k, k] - (b * solved[..., 0]).sum(1), 0)
        return good, solved[:, -1, 0] / size[:, -1], solved[:, -1, 1] / size[:, -1] ** 2, rss


def adaptive_gamma(z: np.ndarray, live: np.ndarray, ahead: np.ndarray, grid: np.ndarray, refine: bool) -> np.ndarray:
    """For each site the mixing weight with the least r' Q^-1 r + log det Q: the best of a grid, then, if asked, by golden section beside it."""

    def cost(gamma: np.ndarray) -> np.ndarray:
        total, logdet = innovate(z, live, ahead, gamma)
        good, *_, rss = normal_equations(total)
        return np.where(good, rss + logdet, np.inf)

    best = np.stack([cost(np.full(len(z), g)) for g in grid]).argmin(0)
    if not refine:
        return grid[best]
    return golden(cost, grid[np.maximum(0, best - 1)], grid[np.minimum(len(grid) - 1, best + 1)], 45)


# ---- smoothing splines ----


class Band:
    """Natural cubic smoothing splines on common times, by the pentadiagonal system of their second derivatives.

    With curvature operator Q' and Gram matrix R, second derivatives c solve (R + f Q'Q) c = Q'y, and the spline is
    y - f Q c, f = (1 - p) / p for p * squares + (1 - p) * curvature. f may differ from site to site: all steps are
    vectors over sites, so a series costs time in proportion to its length.
    """

    def __init__(self, t: np.ndarray):
        self.t, self.h = np.asarray(t, float), np.diff(np.asarray(t, float))
        h = self.h
        self.q0, self.q1, self.q2 = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]  # column j of Q has rows j, j + 1, j + 2
        m = len(h) - 1
        self.r = [(h[:-1] + h[1:]) / 3, h[1:m] / 6, np.zeros(max(0, m - 2))]
        self.g = [self.q0**2 + self.q1**2 + self.q2**2, self.q1[:-1] * self.q0[1:] + self.q2[:-1] * self.q1[1:], self.q2[:-2] * self.q0[2:]]

    def across(self, y: np.ndarray) -> np.ndarray:
        """Q'y"""
        return y[..., :-2] * self.q0 + y[..., 1:-1] * self.q1 + y[..., 2:] * self.q2

    def along(self, c: np.ndarray) -> np.ndarray:
        """Q c"""
        out = np.zeros((*c.shape[:-1], len(self.t)))
        out[..., :-2] += c * self.q0
        out[..., 1:-1] += c * self.q1
        out[..., 2:] += c * self.q2
        return out

    def factor(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """d, l1, l2 of R + f Q'Q = L D L' for each f (one, or one a site)."""
        f = np.atleast_1d(np.asarray(f, float))
        a0, a1, a2 = (np.concatenate([r + f[:, None] * g, np.zeros((len(f), i))], 1) for i, (r, g) in enumerate(zip(self.r, self.g)))
        m = a0.shape[1]
        d, l1, l2 = np.zeros((len(f), m)), np.zeros((len(f), m)), np.zeros((len(f), m))
        for j in range(m):
            d[:, j] = a0[:, j]
            b = a1[:, j].copy()
            if j:
                d[:, j] -= l1[:, j - 1] ** 2 * d[:, j - 1]
                b -= l1[:, j - 1] * d[:, j - 1] * l2[:, j - 1]
            if j > 1:
                d[:, j] -= l2[:, j - 2] ** 2 * d[:, j - 2]
            l1[:, j], l2[:, j] = b / d[:, j], a2[:, j] / d[:, j]
        return d, l1, l2

    def solve(self, factor: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        """The solutions for each row of b (rows x inner times)."""
        d, l1, l2 = factor
        m = d.shape[1]
        z = np.broadcast_to(b, (max(len(b), len(d)), m)).copy()
        for j in range(1, m):
            z[:, j] -= l1[:, j - 1] * z[:, j - 1]
            if j > 1:
                z[:, j] -= l2[:, j - 2] * z[:, j - 2]
        z /= d
        for j in range(m - 2, -1, -1):
            z[:, j] -= l1[:, j] * z[:, j + 1]
            if j + 2 < m:
                z[:, j] -= l2[:, j] * z[:, j + 2]
        return z

    def freedom(self, factor: tuple[np.ndarray, np.ndarray, np.ndarray], f: np.ndarray) -> np.ndarray:
        """The trace of the smoother, from the band of the inverse."""
        d, l1, l2 = factor
        n_f, m = d.shape
        v0, v1, v2 = np.zeros((n_f, m + 2)), np.zeros((n_f, m + 2)), np.zeros((n_f, m + 2))
        for j in range(m - 1, -1, -1):
            v1[:, j] = -l1[:, j] * v0[:, j + 1] - l2[:, j] * v1[:, j + 1]
            v2[:, j] = -l1[:, j] * v1[:, j + 1] - l2[:, j] * v0[:, j + 2]
            v0[:, j] = 1 / d[:, j] - l1[:, j] * v1[:, j] - l2[:, j] * v2[:, j]
        trace = (v0[:, :m] * self.g[0]).sum(1) + 2 * (v1[:, : m - 1] * self.g[1]).sum(1) + 2 * (v2[:, : max(0, m - 2)] * self.g[2]).sum(1)
        return len(self.t) - np.atleast_1d(f) * trace

    def _ends(self, at: float) -> tuple[np.ndarray, np.ndarray]:
        """The spline at a point as weights of its values and of its second derivatives (inner times); linear beyond the ends."""
        t, n = self.t, len(self.t)
        i = int(np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2))
        step = self.h[i]
        a, b = (t[i + 1] - at) / step, (at - t[i]) / step
        w, e = np.zeros(n), np.zeros(n)
        w[i], w[i + 1] = a, b
        if at > t[-1]:
            e[i] = (at - t[-1]) * step / 6
        elif at < t[0]:
            e[i + 1] = (t[0] - at) * step / 6
        else:
            e[i], e[i + 1] = (a**3 - a) * step**2 / 6, (b**3 - b) * step**2 / 6
        return w, e[1:-1]

    def at(self, y: np.ndarray, c: np.ndarray, f: np.ndarray, at: float) -> np.ndarray:
        w, e = self._ends(at)
        return (y - np.atleast_1d(f)[:, None] * self.along(c)) @ w + c @ e

    def row(self, factor: tuple[np.ndarray, np.ndarray, np.ndarray], f: np.ndarray, at: float) -> np.ndarray:
        """The weights of the values of a series in its spline at a point."""
        w, e = self._ends(at)
        return w + self.along(self.solve(factor, e[None] - np.atleast_1d(f)[:, None] * self.across(w)[None]))


def spline_trend(t: np.ndarray, y: np.ndarray, p: float, at: float) -> tuple[np.ndarray, np.ndarray]:
    """The spline of each series (series x times) at its times, and at a point."""
    band, f = Band(t), (1 - p) / p
    c = band.solve(band.factor(f), band.across(y))
    return y - f * band.along(c), band.at(y, c, f, at)


def spline_select(band: Band, y: np.ndarray) -> np.ndarray:
    """For each series the ratio f = (1 - p) / p with the least corrected Akaike criterion, p by logit from a grid, then by golden section."""
    n, inner = len(band.t), band.across(y)

    def cost(logit: np.ndarray) -> np.ndarray:
        f = np.exp(-logit)
        factor = band.factor(f)
        df = band.freedom(factor, f)
        rss = (f[:, None] ** 2 * band.along(band.solve(factor, inner)) ** 2).sum(1)
        with np.errstate(all="ignore"):
            value = n * np.log(np.maximum(rss, 1e-300) / n) + 2 * n * (df + 1) / (n - df - 2)
        return np.where(n - df - 2 <= 0, np.inf, value)

    grid = np.linspace(-16, 12, 29)
    best = np.stack([cost(np.array([g])) for g in grid]).argmin(0)
    return np.exp(-golden(cost, grid[np.maximum(0, best - 1)], grid[np.minimum(28, best + 1)], 40))


def spline_fit(t: np.ndarray, y: np.ndarray, at: float) -> Fits:
    """Mean of each series' spline at a point, scale from residual variance and the smoother's own, and degrees of freedom."""
    if len(t) < 4:  # no criterion
        none = np.full(len(y), np.nan)
        return none, none, none
    band = Band(t)
    f = spline_select(band, y)
    factor = band.factor(f)
    c = band.solve(factor, band.across(y))
    nu = len(t) - band.freedom(factor, f)
    s2 = (f[:, None] ** 2 * band.along(c) ** 2).sum(1) / nu
    return band.at(y, c, f, at), np.sqrt(s2 * (1 + (band.row(factor, f, at) ** 2).sum(1))), nu
