"""Fits that search for a penalty or a smoothing weight, against the definitions and a search by ever finer grids."""

import math

import numpy as np
import pytest

from foretide.functions import kernels
from foretide.plans import predict as P
from tests.test_methods import AT, NO, K, N, data, expected, run  # noqa: F401

T = np.arange(1, NO + 1.0)


def least(cost, low, high, rounds=14):
    for _ in range(rounds):
        xs = np.linspace(low, high, 101)
        i = int(np.argmin([cost(x) for x in xs]))
        low, high = xs[max(0, i - 2)], xs[min(100, i + 2)]
    return (low + high) / 2


def standard_form(x, y, prior, free, cov):
    """The problem where all coefficients are shrunk to zero under white noise, and the way back from its solution."""
    k = x.shape[1]
    l = np.eye(k)[free:]
    null = np.linalg.pinv(x @ np.diag([1.0] * free + [0.0] * (k - free)))
    back = (np.eye(k) - null @ x) @ np.linalg.pinv(l)
    b = y - x @ prior
    upper = np.linalg.cholesky(cov).T
    return np.linalg.solve(upper, x @ back), np.linalg.solve(upper, b - x @ null @ b), back, null @ b + prior


def shrunk(x, y, at, prior, free, cov):
    a, b, back, rest = standard_form(x, y, prior, free, cov)
    n, k = a.shape

    def ridge(p):
        inverse = np.linalg.inv(a.T @ a + p * np.eye(k))
        return inverse, inverse @ a.T @ b, np.trace(a @ inverse @ a.T)

    def criterion(log_p):
        _, z, df = ridge(math.exp(log_p))
        return n * (math.log(((b - a @ z) ** 2).sum() / n) + 2 * df / (n - df - 1))

    s = np.linalg.svd(a)[1]
    inverse, z, df = ridge(math.exp(least(criterion, math.log(s[-1] / 1e3 + 2**-52), math.log(s[0] * 1e3 + 2**-52))))
    nu = n - df - free
    lever = at @ back @ inverse @ a.T @ a @ inverse @ back.T @ at
    return at @ (back @ z + rest), math.sqrt(((b - a @ z) ** 2).sum() / nu * (1 + lever)), nu


@pytest.mark.parametrize("name", ["model_linear_reg", "multimodel_linear_reg", "ewma_linear_model_reg", "ewma_linear_multimodel_reg"])
def test_regularised(data, name):  # noqa: F811
    o = P.Options(t_pred=AT, timescale=9.0)
    y, f, w = data[3:]
    rel = f[:, :NO] - f[:, NO:]
    xs = [rel[:, :, k] for k in range(K)] if "multi" in name else [rel.mean(2)]
    v = AT - T
    ww = np.repeat(w, NO)
    centred = [x - x.mean(1, keepdims=True) for x in xs]
    design = np.stack([np.ones(N * NO), np.tile(v, N), *(x.ravel() for x in centred)], 1)
    prior = np.linalg.lstsq(design * ww[:, None], y.ravel() * ww, rcond=None)[0]
    prior[:2] = 0
    cov = (1 - o.gamma) * np.eye(NO) + o.gamma * np.minimum(v[:, None], v[None]) if name.startswith("ewma") else np.eye(NO)
    want = [shrunk(np.stack([np.ones(NO), v, *(x[s] for x in xs)], 1), y[s], np.eye(2 + len(xs))[0], prior, 2, cov) for s in range(N)]
    np.testing.assert_allclose(run(data, name, o), want, rtol=1e-6, atol=1e-6)


def radial(t, at, p):
    """Rows of the smoothing spline as a line and cubes of distances, whose curvature is a quadratic form of the cubes."""
    n = len(t)
    cubes = lambda x: np.abs(np.asarray(x, float)[:, None] - t[None]) ** 3 / 12
    line = lambda x: np.stack([np.ones(len(x)), np.asarray(x, float)], 1)
    left = np.block([[cubes(t) + (1 - p) / p * np.eye(n), line(t)], [line(t).T, np.zeros((2, 2))]])
    solution = np.linalg.solve(left, np.vstack([np.eye(n), np.zeros((2, n))]))
    return np.hstack([cubes(at), line(at)]) @ solution


def spline(y):
    n = len(y)

    def criterion(logit):
        s = radial(T, T, 1 / (1 + math.exp(-logit)))
        df = np.trace(s)
        return n * math.log(((y - s @ y) ** 2).sum() / n) + 2 * n * (df + 1) / (n - df - 2) if n - df - 2 > 0 else math.inf

    p = 1 / (1 + math.exp(-least(criterion, -16, 12)))
    s, row = radial(T, T, p), radial(T, [AT], p)[0]
    nu = n - np.trace(s)
    return row @ y, math.sqrt(((y - s @ y) ** 2).sum() / nu * (1 + row @ row)), nu


@pytest.mark.parametrize("p", [1e-4, 0.03, 0.7])
def test_smoother(p):
    t = np.array([0.0, 1, 2.5, 3, 7, 8])
    at = [-2.0, 0, 0.4, 2.7, 5, 8, 9.5]
    np.testing.assert_allclose(kernels.smoother(t, at, p), radial(t, at, p), atol=1e-8)


@pytest.mark.parametrize("name", ["spline", "spline_scaled"])
def test_spline(data, name):  # noqa: F811
    got, want = np.asarray(run(data, name, P.Options(t_pred=AT))), np.asarray([spline(y) for y in data[3]])
    np.testing.assert_allclose(got, want, rtol=2e-6, atol=2e-6)


@pytest.mark.parametrize("name", ["ma", "ewma", "ewma_linear"])
def test_corrected_by_the_global_mean(data, name):  # noqa: F811
    o = P.Options(t_pred=AT, timescale=9.0)
    y, w = data[3], data[5]
    mean = w @ y / w.sum()
    shift = spline(mean)[0] - expected(name, np.tile(mean, (N, 1)), data[4], w, o)[0][0]
    want = [(mu + shift, sigma, nu) for mu, sigma, nu in expected(name, y, data[4], w, o)]
    np.testing.assert_allclose(run(data, f"{name}_globcorr", o), want, rtol=2e-6, atol=2e-6)
