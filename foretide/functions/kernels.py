"""Small dense algebra for one site: regressions, regularised fits and smoothing splines in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

EPS = float(np.finfo(float).eps)
Fit = tuple[float, float, float]


def golden(cost: Callable[[float], float], low: float, high: float, steps: int = 80) -> float:
    """Minimum of a function of one variable on an interval."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = cost(a), cost(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = cost(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = cost(b)
        if high - low < 1e-10:
            break
    return (low + high) / 2


def ols(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> Fit:
    """Least squares prediction at a row `at`: mean, scale, degrees of freedom."""
    q, r = np.linalg.qr(x)
    beta, inner = np.linalg.solve(r, q.T @ y), np.linalg.solve(r.T, at)
    nu = len(y) - x.shape[1]
    rss = float(((y - x @ beta) ** 2).sum())
    return float(at @ beta), math.sqrt(rss / nu * (1 + float(inner @ inner))) if nu > 0 else math.nan, float(nu)


def walk_covariance(ahead: np.ndarray, gamma: float) -> np.ndarray:
    """White noise mixed with a random walk that ends at the target, `ahead` steps away."""
    return (1 - gamma) * np.eye(len(ahead)) + gamma * np.minimum.outer(ahead, ahead)


def walk_weights(x: np.ndarray, ahead: np.ndarray, gamma: float) -> np.ndarray:
    """The weights of the values of one series in its prediction (the first coefficient of x) under walk_covariance."""
    half = np.linalg.inv(np.linalg.cholesky(walk_covariance(ahead, gamma)))
    q, r = np.linalg.qr(half @ x)
    return (np.linalg.inv(r) @ q.T @ half)[0]


def adaptive_gamma(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, low: float = 0.0, high: float = 1.0) -> float:
    """The mixing weight with the least r' Q^-1 r + log det Q."""

    def cost(gamma: float) -> float:
        q = walk_covariance(ahead, gamma)
        half = np.linalg.cholesky(q + 1e-12 * np.eye(len(q)))
        xw, yw = np.linalg.solve(half, x), np.linalg.solve(half, y)
        r = yw - xw @ np.linalg.lstsq(xw, yw, rcond=None)[0]
        return float(r @ r) + 2 * float(np.log(np.diag(half)).sum())

    return golden(cost, low, high)


def shrunk(x: np.ndarray, y: np.ndarray, at: np.ndarray, prior: np.ndarray, free: int, scale: np.ndarray | float = 1.0, upper: np.ndarray | None = None, penalty: float | None = None) -> Fit:
    """Tikhonov fit that pulls all but the first `free` coefficients to `prior`.

    The free columns are projected out, the rest divided by 1/scale, both sides solved against the factor `upper` of
    the error covariance, and the penalty, unless given, has the least corrected Akaike criterion.
    """
    r, x1, x2 = y - x @ prior, x[:, :free], x[:, free:] * scale
    own = np.linalg.pinv(x1) if free else np.zeros((0, len(y)))
    a, b = x2 - x1 @ (own @ x2), r - x1 @ (own @ r)
    if upper is not None:
        a, b = np.linalg.solve(upper, a), np.linalg.solve(upper, b)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    n, s2, ub = len(y), s**2, u.T @ b
    outside = max(0.0, float(b @ b - ub @ ub))

    def rss_at(p: float) -> float:
        return outside + float(((p / (s2 + p)) ** 2 * ub**2).sum())

    def criterion(log_p: float) -> float:
        p = math.exp(log_p)
        k = float((s2 / (s2 + p)).sum())
        return n * (math.log(max(rss_at(p), 1e-300) / n) + 2 * k / (n - k - 1))

    if penalty is None:
        penalty = math.exp(golden(criterion, math.log(s[-1] / 1e3 + EPS), math.log(s[0] * 1e3 + EPS)))
    gain = s / (s2 + penalty)
    z = vt.T @ (gain * ub)
    beta = np.concatenate([own @ (r - x2 @ z), np.ones(len(z)) * scale * z]) + prior
    back = np.concatenate([-own @ x2, np.diag(np.ones(len(z)) * scale)])
    lever = (at @ back) @ vt.T * gain
    nu = n - float((s2 / (s2 + penalty)).sum()) - free
    return float(at @ beta), math.sqrt(rss_at(penalty) / nu * (1 + float(lever @ lever))), nu


def smoother(t: np.ndarray, at: np.ndarray, p: float) -> np.ndarray:
    """Rows of the natural cubic smoothing spline of p * squares + (1 - p) * curvature, at the points `at`; linear beyond the ends."""
    t, n = np.asarray(t, float), len(t)
    h = np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    curve = np.linalg.solve(r, q.T)
    fit = np.linalg.inv(np.eye(n) + (1 - p) / p * q @ curve)
    second = np.vstack([np.zeros(n), curve @ fit, np.zeros(n)])
    out = []
    for x in np.asarray(at, float):
        i = int(np.clip(np.searchsorted(t, x, "right") - 1, 0, n - 2))
        step, a, b = h[i], (t[i + 1] - x) / h[i], (x - t[i]) / h[i]
        row = a * fit[i] + b * fit[i + 1]
        if x > t[-1]:
            row = row + (x - t[-1]) * step / 6 * second[i]
        elif x < t[0]:
            row = row + (t[0] - x) * step / 6 * second[i + 1]
        else:
            row = row + ((a**3 - a) * second[i] + (b**3 - b) * second[i + 1]) * step**2 / 6
        out.append(row)
    return np.asarray(out)


def spline_select(t: np.ndarray, y: np.ndarray) -> float:
    """The smoothing weight with the least corrected Akaike criterion, by logit."""
    n = len(t)

    def cost(logit: float) -> float:
        s = smoother(t, t, 1 / (1 + math.exp(-logit)))
        df, rss = float(np.trace(s)), float(((y - s @ y) ** 2).sum())
        return math.inf if n - df - 2 <= 0 else n * math.log(max(rss, 1e-300) / n) + 2 * n * (df + 1) / (n - df - 2)

    grid = np.linspace(-16, 12, 29)
    best = int(np.argmin([cost(g) for g in grid]))
    return 1 / (1 + math.exp(-golden(cost, grid[max(0, best - 1)], grid[min(28, best + 1)], 40)))


def spline_fit(t: np.ndarray, y: np.ndarray, at: float, p: float | None = None) -> Fit:
    """Mean of the spline at a point, scale from residual variance and the smoother's own, and degrees of freedom."""
    p = spline_select(t, y) if p is None else p
    s, row = smoother(t, t, p), smoother(t, [at], p)[0]
    nu = len(y) - float(np.trace(s))
    s2 = float(((y - s @ y) ** 2).sum()) / nu
    return float(row @ y), math.sqrt(s2 * (1 + float(row @ row))), nu


def nelder_mead(cost: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, steps: int = 40, size: float = 0.1, tolerance: float = 1e-4) -> np.ndarray:
    """Simplex search; cost takes a list of candidates, so that a step asks for all its points in one job."""
    points = [np.asarray(start, float)] + [np.asarray(start, float) + size * np.eye(len(start))[i] for i in range(len(start))]
    values = cost(points)
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points) < tolerance:
            break
        centre, worst = np.mean(points[:-1], 0), points[-1]
        tried = [centre + f * (centre - worst) for f in (1, 2, 0.5, -0.5)]
        got = cost(tried)
        reflect, expand, near, inside = got
        if reflect < values[0]:
            pick = 1 if expand < reflect else 0
        elif reflect < values[-2]:
            pick = 0
        elif min(near, inside) < min(reflect, values[-1]):
            pick = 2 if near < inside else 3
        else:
            points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
            values = cost(points)
            continue
        points[-1], values[-1] = tried[pick], got[pick]
    return points[int(np.argmin(values))]
