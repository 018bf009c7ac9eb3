"""Many targets in one plan against one plan a target; long histories; stacked fits with gaps."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.functions import kernels, stacks
from foretide.plans import predict as P
from foretide.plans import targets

N, NO, K = 6, 18, 2


@pytest.fixture(scope="module")
def panel(spark):
    """Observations and forecasts of two leads with gaps, a site without weight, one with two values, one without a forecast at a target."""
    r = np.random.default_rng(8)
    y = 1e4 + np.cumsum(r.normal(size=(N + 2, NO + 1)), 1) * 50
    obs = [(s, t, float(y[s, t])) for s in range(N + 2) for t in range(NO + 1) if not (s == 2 and t in (3, 9)) and not (s == N and t > 1)]
    fcst = [(s, t, f"m{k}", lag, float(y[s, t] * 0.5 + 100 * r.normal())) for lag in (1, 2) for s in range(N + 2) for t in range(NO + 1) for k in range(K) if not (s == 3 and t == 4 and k == 1) and not (s == 4 and t == 17 and lag == 2)]
    w = [(s, float(r.uniform(0.5, 2))) for s in range(N + 1)]
    o = spark.createDataFrame(obs, "site long, t int, value double").cache()
    return o, spark.createDataFrame(fcst, "site long, t int, model string, lag int, value double").cache(), spark.createDataFrame(w, "site long, w double")


def test_equals_one_plan_a_target(panel):
    obs, fcst, weights = panel
    times, o = [12, 17], P.Options(t_pred=0, timescale=6.0)
    got = {(r["method"], r["t"], r["lag"], r["site"]): tuple(r)[4:] for r in targets.predict_many(list(targets.METHODS), obs, fcst, times, o, weights, [1, 2]).collect()}
    for name in targets.METHODS:
        at, lag = (17, 2) if name not in ("history", "rawmodel") else (12, 1)
        want = {r["site"]: tuple(r)[1:] for r in P.predict(name, obs, fcst.where(f"lag = {lag}").drop("lag"), P.Options(t_pred=at, timescale=6.0), weights).where("mu IS NOT NULL").collect()}
        mine = {k[3]: v for k, v in got.items() if k[:3] == (name, at, lag)}
        assert mine.keys() == want.keys() and len(want) > 3, name
        for s in want:
            for a, b in zip(mine[s], want[s]):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6 * max(1, abs(b))), (name, s, mine[s], want[s])


def test_without_forecasts_or_weights(spark, panel):
    obs, fcst, _ = panel
    got = targets.predict_many(["linear"], obs, None, [12, 40]).where("t = 40").orderBy("site").collect()
    want = P.predict("linear", obs, None, P.Options(t_pred=40)).where("mu IS NOT NULL").orderBy("site").collect()
    np.testing.assert_allclose([r["mu"] for r in got], [r["mu"] for r in want], rtol=1e-9)
    one = targets.predict_many(["rawmodel_globscaled"], obs, fcst.where("lag = 1").drop("lag"), [12]).count()
    assert one == P.predict("rawmodel_globscaled", obs, fcst.where("lag = 1").drop("lag"), P.Options(t_pred=12)).count()
    assert targets.predict_many(["linear"], obs.limit(0), None, [12]).count() == 0
    with pytest.raises(ValueError):
        targets.predict_many(["trend"], obs, fcst, [12])
    with pytest.raises(ValueError):
        targets.predict_many(["rawmodel"], obs, None, [12])


@pytest.mark.parametrize("p", [1e-4, 0.03, 0.7, 0.9999])
def test_band_equals_dense_smoother(p):
    """Values, the point, its weights and the trace against the smoother's whole matrix, on uneven times."""
    r = np.random.default_rng(1)
    t = np.cumsum(r.uniform(0.3, 2, size=25))
    y, f = r.normal(size=(4, 25)), (1 - p) / p
    dense = kernels.smoother(t, t, p)
    for at in (t[-1] + 1.7, t[0] - 2, t[7] + 0.1):
        trend, ahead = stacks.spline_trend(t, y, p, at)
        row = kernels.smoother(t, [at], p)[0]
        np.testing.assert_allclose(trend, y @ dense.T, atol=1e-8)
        np.testing.assert_allclose(ahead, y @ row, atol=1e-8)
        band = stacks.Band(t)
        np.testing.assert_allclose(band.row(band.factor(f), f, at)[0], row, atol=1e-8)
    assert abs(band.freedom(band.factor(f), f)[0] - np.trace(dense)) < 1e-8


def test_chosen_weight_equals_one_series():
    r = np.random.default_rng(2)
    t = np.arange(1, 31.0)
    y = np.sin(t / 4) + 0.3 * r.normal(size=(5, 30))
    mu, sigma, nu = stacks.spline_fit(t, y, 31.0)
    np.testing.assert_allclose(np.stack([mu, sigma, nu], 1), [kernels.spline_fit(t, v, 31.0) for v in y], rtol=1e-6)


def test_stacked_fits_leave_rows_out():
    """Masked rows equal rows that are not there; dependent columns and short histories give NaN, not an error."""
    r = np.random.default_rng(3)
    x, y = np.concatenate([np.ones((8, 20, 1)), r.normal(size=(8, 20, 3))], 2), r.normal(size=(8, 20))
    live = r.uniform(size=(8, 20)) < 0.7
    live[6], x[7, :, 2] = np.arange(20) < 2, 2 * x[7, :, 1]
    at, prior = r.normal(size=(8, 4)), np.array([0, 0.5, -1, 2])
    mu, sigma, nu = stacks.ols(np.where(live[..., None], x, np.nan), np.where(live, y, np.nan), live, at)
    smu, ssigma, snu = stacks.shrunk(x, y, live, at, prior, 1)
    for s in range(6):
        own = live[s]
        np.testing.assert_allclose((mu[s], sigma[s], nu[s]), kernels.ols(x[s][own], y[s][own], at[s]), rtol=1e-9)
        np.testing.assert_allclose((smu[s], ssigma[s], snu[s]), kernels.shrunk(x[s][own], y[s][own], at[s], prior, 1), rtol=1e-6)
    assert np.isnan(mu[6:]).all() and np.isnan(sigma[6:]).all()
    assert np.isnan(stacks.spline_fit(np.arange(3.0), np.zeros((2, 3)), 4.0)[0]).all()


@pytest.mark.parametrize("name", ["ewma", "ewma_linear_model", "trend", "quadratic"])
def test_long_histories(spark, name):
    """408 times: a plan's size and time grow with the length, not with its square."""
    d = spark.range(20 * 409).select((F.col("id") / 409).cast("long").alias("site"), (F.col("id") % 409).cast("int").alias("t"))
    obs = d.withColumn("value", F.sin(F.col("t") / 7) + F.col("site") + (F.xxhash64("site", "t") % 1000) / 3000)
    fcst = obs.crossJoin(spark.createDataFrame([("a",), ("b",)], "model string")).withColumn("value", F.col("value") + (F.xxhash64("site", "t", "model") % 1000) / 2000)
    began = time.monotonic()
    rows = P.predict(name, obs, fcst, P.Options(t_pred=408)).collect()
    assert len(rows) == 20 and all(math.isfinite(r["mu"]) and r["sigma"] > 0 for r in rows)
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("degree", [0, 1])
def test_adaptive_weight(spark, degree):
    """The searched mixing weight against the search over dense matrices, and its fit against the method at that weight."""
    r = np.random.default_rng(4)
    n = 25
    y = np.cumsum(r.normal(size=(6, n)), 1) * np.array([0, 0.3, 0.7, 1, 1.5, 3])[:, None] + r.normal(size=(6, n))
    obs = spark.createDataFrame([(s, t, float(y[s, t])) for s in range(6) for t in range(n)], "site long, t int, value double")
    got = P.adaptive_walk(P.Inputs(obs, None, None, P.Options(t_pred=n)), degree).orderBy("site").collect()
    ahead = n - np.arange(n, dtype=float)
    x = np.stack([ahead**d for d in range(degree + 1)], 1)

    def cost(g, v):
        q = kernels.walk_covariance(ahead, g)
        qi = np.linalg.inv(q)
        rest = v - x @ np.linalg.solve(x.T @ qi @ x, x.T @ qi @ v)
        return rest @ qi @ rest + np.linalg.slogdet(q)[1]

    for s, g in enumerate(got):
        best = min(cost(c, y[s]) for c in np.linspace(1e-9, 1, 2001))
        assert cost(max(g["gamma"], 1e-9), y[s]) <= best + 1e-3
        o = P.Options(t_pred=n, timescale=math.sqrt(1 / max(g["gamma"], 1e-12) - 1)) if g["gamma"] < 1 else P.Options(t_pred=n, timescale=0.0)
        want = P.predict("ewma_linear" if degree else "ewma", obs.where(f"site = {s}"), None, o).first()
        np.testing.assert_allclose(tuple(g)[2:], tuple(want)[1:], rtol=1e-6)


def test_calibrated_methods(panel):
    """Factors of one method change its scale and degrees of freedom and no other's."""
    from foretide.plans import study

    obs, fcst, weights = panel
    run = lambda f: {(r["method"], r["site"]): (r["sigma"], r["nu"]) for r in study.verify_methods(obs, fcst.where("lag = 1").drop("lag"), ["linear", "rawmodel", "trend"], [17], P.Options(t_pred=0), weights, factors=f).collect()}
    plain, changed = run(None), run({"rawmodel": (math.log(2), math.log(4)), "trend": (0.0, math.log(0.5))})
    assert plain.keys() == changed.keys() and {m for m, _ in plain} == {"linear", "rawmodel", "trend"}
    for (m, s), (sigma, nu) in plain.items():
        a, b = {"linear": (1, 1), "rawmodel": (2, 0.25), "trend": (1, 2)}[m]
        assert changed[m, s] == (pytest.approx(sigma * a), pytest.approx(nu * b))
