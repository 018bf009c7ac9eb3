"""Prediction methods: site, mu, sigma, nu of a Student t for the target time.

A method is one plan. Means, lines and parabolas are aggregates by site. Random walks plus noise are fitted by the
innovations of a filter, one fold over a site's history. Global coefficients come from one aggregate of cross products
and enter as literals. Penalised fits, fits of several models and smoothing splines run in numpy on whole batches of
sites (`functions.stacks`), whose histories were gathered by one shuffle; time and memory grow with the length of a
history, and no plan holds more numbers than a history is long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions import kernels, stacks
from foretide.functions.special import t_entropy


def _site():
    return Window.partitionBy("site")


@dataclass(frozen=True)
class Options:
    t_pred: int
    clim: tuple[int, ...] | None = None  # times of the climatology; all by default
    timescale: float = 30.0
    dof_spline: float = 2.5
    lamda: float = 10.0
    spline_p: float = 3e-4
    of: tuple[str, ...] = field(default=("history", "linear"))  # the methods that multimethod chooses from

    @property
    def gamma(self) -> float:
        return 1 / (1 + self.timescale**2)


class Inputs:
    """The panels of one prediction: obs (site, t, value), fcst (site, t, model, value), weights (site, w)."""

    def __init__(self, obs: DataFrame, fcst: DataFrame | None, weights: DataFrame | None, options: Options):
        self.o, self.weights = options, weights
        self.obs = obs.where((F.col("t") < options.t_pred) & F.col("value").isNotNull())
        self.fcst = fcst
        self._times = self._models = None

    @property
    def times(self) -> list[int]:
        """The distinct times of the history: as many as a history is long."""
        if self._times is None:
            self._times = sorted(r[0] for r in self.obs.select("t").distinct().collect())
        return self._times

    @property
    def models(self) -> list[str]:
        if self._models is None:
            self._models = sorted(r[0] for r in self.fcst.select("model").distinct().collect())
        return self._models

    def weighted(self, df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.lit(1.0)) if self.weights is None else df.join(self.weights, "site")

    def joined(self, detrend: bool = False, centred: bool = False) -> DataFrame:
        """site, t, y, x1..xk, m, w: models and their mean relative to the target (or centred over history and target)."""
        o, names = self.o, [f"x{i + 1}" for i in range(len(self.models))]
        fcst, obs = self.fcst.where(F.col("value").isNotNull()), self.obs
        if detrend:
            fcst = with_trend(fcst, ["site", "model"], sorted({*self.times, o.t_pred}), o.t_pred, o.spline_p).withColumn("value", F.col("value") - F.col("trend"))
            obs = with_trend(obs, ["site"], self.times, o.t_pred, o.spline_p).withColumn("value", F.col("value") - F.col("trend") + F.col("trend_pred"))
        wide = fcst.groupBy("site", "t").pivot("model", self.models).agg(F.avg("value"))
        wide = wide.toDF("site", "t", *names).withColumn("m", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))
        raw = self.fcst.where(F.col("t") == o.t_pred).groupBy("site").pivot("model", self.models).agg(F.avg("value")).toDF("site", *(f"p{n}" for n in names))
        d = wide.join(obs.select("site", "t", F.col("value").alias("y")), ["site", "t"], "left")
        d = d.where(F.col("y").isNotNull() | (F.col("t") == o.t_pred))
        at = lambda c: F.max(F.when(F.col("t") == o.t_pred, F.col(c))).over(_site())
        d = d.withColumns({c: F.col(c) - (F.avg(c).over(_site()) if centred else at(c)) for c in [*names, "m"]})
        if centred:
            d = d.withColumns({f"at_{c}": at(c) for c in [*names, "m"]})
        d = d.where((F.col("t") < o.t_pred) & F.col("m").isNotNull())
        return self.weighted(d.join(raw, "site") if detrend else d)


#: Numbers of a tensor of sites x times, about, at most.
MOST_CELLS = 2_000_000


def series_tensors(batch, columns: list[str]) -> Iterator[tuple]:
    """A batch of series (s: list of structs t, columns) in parts: slice, times, which series has which (series x times), and the columns; 0 where there is none."""
    lists, start = batch.column("s"), 0
    sizes = np.diff(lists.offsets.to_numpy()[: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
    while start < batch.num_rows:
        n = max(1, min(batch.num_rows - start, MOST_CELLS // max(1, int(sizes[start:].max()) * (len(columns) + 1))))
        flat = lists.slice(start, n).flatten()
        own = np.repeat(np.arange(n), sizes[start : start + n])
        times, place = np.unique(flat.field("t").to_numpy(zero_copy_only=False), return_inverse=True)
        live = np.zeros((n, len(times)), bool)
        live[own, place] = True
        out = []
        for c in columns:
            x = np.zeros(live.shape)
            x[own, place] = flat.field(c).to_numpy(zero_copy_only=False)
            out.append(x)
        yield slice(start, start + n), times.astype(float), live, *out
        start += n


def with_trend(df: DataFrame, keys: list[str], times: list[int], t_pred: int, p: float) -> DataFrame:
    """df (keys, t, value) -> the same at the times given, of series complete there, with the spline's trend, and the trend at the target."""
    s = df.where(F.col("t").isin(times)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).where(F.size("s") == len(times))
    kinds = dict(df.dtypes)

    def smoothed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows, t, _, y in series_tensors(batch, ["value"]):
                trend, ahead = stacks.spline_trend(t, y, p, t_pred)
                place = pa.array(np.repeat(np.arange(rows.start, rows.stop), len(t)))
                columns = [batch.column(k).take(place) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(t.astype(np.int32), len(y))), *(pa.array(x) for x in (y.ravel(), trend.ravel(), np.repeat(ahead, len(t))))], names=[*keys, "t", "value", "trend", "trend_pred"])

    return s.mapInArrow(smoothed, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t int, value double, trend double, trend_pred double")


def _moments(df: DataFrame, value: Column, shift: Column | float = 0.0, inflate: bool = False) -> DataFrame:
    """Mean and spread of a value by site; inflate: the spread of a new value about an estimated mean."""
    r = df.select("site", value.alias("r")).groupBy("site").agg(F.avg("r").alias("a"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    grow = F.sqrt(1 + 1 / F.col("n")) if inflate else F.lit(1.0)
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    return r.select("site", (F.col("a") + shift).alias("mu"), (F.col("s") * grow).alias("sigma"), (F.col("n") - 1).cast("double").alias("nu"))


def _line(df: DataFrame, y: Column, x: Column, at: float) -> DataFrame:
    """Regression on one variable, predicted at a value of it."""
    g = df.select("site", y.alias("y"), x.alias("x")).groupBy("site").agg(
        F.count("y").alias("n"), F.avg("x").alias("xm"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy")
    )
    sse = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    lever = 1 + 1 / F.col("n") + F.pow(at - F.col("xm"), 2) / F.col("sxx")
    nu = F.col("n") - 2
    return g.select("site", (F.col("a") + F.col("b") * at).alias("mu"), F.when(nu > 0, F.sqrt(sse / nu * lever)).alias("sigma"), nu.cast("double").alias("nu"))


def global_coefficients(df: DataFrame, y: Column, xs: list[Column], power: int = 2) -> np.ndarray:
    """Least squares over all rows with weights w^power, from one aggregate of cross products."""
    names = [*(f"c{i}" for i in range(len(xs))), "c_y"]
    d = df.select(F.pow("w", power).alias("ww"), *(c.alias(n) for c, n in zip([*xs, y], names)))
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(names))]
    sums = d.agg(*(F.sum(F.col("ww") * F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()  # (k + 1)(k + 2) / 2 numbers
    gram, right = np.zeros((len(xs), len(xs))), np.zeros(len(xs))
    for i, j in pairs:
        if j == len(xs):
            right[i] = sums[f"s{i}_{j}"]
        else:
            gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
    size = np.sqrt(np.diag(gram))
    size[size == 0] = 1
    return np.linalg.lstsq(gram / np.outer(size, size), right / size, rcond=None)[0] / size


def centred(c: str) -> Column:
    return F.col(c) - F.avg(c).over(_site())


def gathered(df: DataFrame, columns: list[str]) -> DataFrame:
    """site, s: each site's rows by time, after one shuffle."""
    return df.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("t", *(c for c in columns if c != "t")))).alias("s"))


def _by_batch(df: DataFrame, columns: list[str], fit: Callable[..., tuple], names: tuple[str, ...] = ("mu", "sigma", "nu")) -> DataFrame:
    """fit(times, live, the columns as sites x times) -> mean, scale and degrees of freedom (or other names) of all sites of a batch; NaN is null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows, t, live, *arrays in series_tensors(batch, columns):
                out = fit(t, live, *arrays)
                yield pa.RecordBatch.from_arrays([batch.column("site").slice(rows.start, len(live)), *(pa.array(x, from_pandas=True) for x in out)], names=["site", *names])

    return gathered(df, columns).mapInArrow(run, f"site {dict(df.dtypes)['site']}, " + ", ".join(f"{n} double" for n in names))


def innovations(s: DataFrame, xs: list[str], gamma: float, lost: int) -> DataFrame:
    """s (site, s: structs v, y, xs by v, the steps to the target) -> mean, scale, degrees of freedom n - lost at the target.

    y is a constant and xs (0 at the target), plus white noise of variance 1 - gamma, plus gamma times a random walk that
    is 0 at the target. Seen from the target the walk is filtered step by step; the innovations of y and of each column
    are independent, so one fold that sums their products gives the normal equations. The constant is eliminated last.
    """
    names, p = [*xs, "one"], len(xs) + 1
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], "y"]] + [("y", "y")]
    zero = F.lit(0.0)
    start = F.struct(zero.alias("p"), zero.alias("v"), *(zero.alias(f"a_{n}") for n in [*names, "y"]), *(zero.alias(f"s_{a}_{b}") for a, b in pairs))

    def step(acc: Column, x: Column) -> Column:
        walk = acc["p"] + gamma * (x["v"] - acc["v"])
        f = walk + (1 - gamma)
        e = {n: (F.lit(1.0) if n == "one" else x[n]) - acc[f"a_{n}"] for n in [*names, "y"]}
        moved = [(acc[f"a_{n}"] + walk / f * e[n]).alias(f"a_{n}") for n in e]
        return F.struct((walk * (1 - gamma) / f).alias("p"), x["v"].alias("v"), *moved, *((acc[f"s_{a}_{b}"] + e[a] * e[b] / f).alias(f"s_{a}_{b}") for a, b in pairs))

    level = F.col("s")[0]["y"]
    shifted = F.transform("s", lambda x: F.struct(x["v"].alias("v"), (x["y"] - level).alias("y"), *(x[c].alias(c) for c in xs if c != "v")))
    d = s.select("site", F.size("s").alias("n"), level.alias("level"), F.aggregate(shifted, start, step).alias("g")).select("site", "n", "level", "g.*")
    # Cholesky's factor and the solution column by column; a dependent column gives nulls
    for j, b in enumerate(names):
        rest = F.col(f"s_{b}_{b}") - sum((F.pow(f"l{j}_{k}", 2) for k in range(j)), zero)
        d = d.withColumn(f"l{j}_{j}", F.when(rest > stacks.DEPENDENT * F.col(f"s_{b}_{b}"), F.sqrt(rest)))
        solved = [((F.col(f"s_{b}_y") - sum((F.col(f"l{j}_{k}") * F.col(f"z{k}") for k in range(j)), zero)) / F.col(f"l{j}_{j}")).alias(f"z{j}")]
        below = [((F.col(f"s_{b}_{names[i]}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), zero)) / F.col(f"l{j}_{j}")).alias(f"l{i}_{j}") for i in range(j + 1, p)]
        d = d.select("*", *solved, *below)
    rss = F.greatest(F.col("s_y_y") - sum((F.pow(f"z{k}", 2) for k in range(p)), zero), zero)
    last = F.col(f"l{p - 1}_{p - 1}")
    variance = rss / (F.col("n") - (p - 1)) * (1 - gamma + 1 / (last * last))
    nu = (F.col("n") - lost).cast("double")
    some = (F.col("n") >= p) & last.isNotNull()
    return d.select("site", F.when(some, F.col("level") + F.col(f"z{p - 1}") / last).alias("mu"), F.when(some & (nu > 0), F.sqrt(variance)).alias("sigma"), F.when(some, nu).alias("nu"))


def global_series(inputs: Inputs) -> tuple[np.ndarray, np.ndarray]:
    """Times and weighted means over sites: as many numbers as a history is long."""
    d = inputs.weighted(inputs.obs).groupBy("t").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("v")).orderBy("t").collect()
    return np.asarray([r["t"] for r in d], float), np.asarray([r["v"] for r in d])


REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {}


def method(*names: str):
    def add(f):
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return add


# ---- history only ----


@method("history", "C")
def history(i: Inputs) -> DataFrame:
    obs = i.obs if i.o.clim is None else i.obs.where(F.col("t").isin(list(i.o.clim)))
    return _moments(obs, F.col("value"))


@method("linear", "T")
def linear(i: Inputs) -> DataFrame:
    return _line(i.obs, F.col("value"), F.col("t").cast("double"), i.o.t_pred)


@method("quadratic")
def quadratic(i: Inputs) -> DataFrame:
    """By polynomials orthogonal over the times, which all sites share."""
    t = np.asarray(i.times, float)
    n, middle, at = len(t), float(t.mean()), float(i.o.t_pred - t.mean())
    u = t - middle
    flat, tilt = float((u**2).mean()), float((u**3).sum() / (u**2).sum())
    s1, s2 = float((u**2).sum()), float(((u**2 - flat - tilt * u) ** 2).sum())
    x1 = F.col("t") - middle
    d = i.obs.where(F.col("t").isin(i.times)).select("site", F.col("value").alias("y"), x1.alias("x1"), (x1 * x1 - flat - tilt * x1).alias("x2"))
    g = d.groupBy("site").agg(F.count("y").alias("n"), F.avg("y").alias("a"), (n * F.covar_pop("x1", "y") / s1).alias("b1"), (n * F.covar_pop("x2", "y") / s2).alias("b2"), (n * F.var_pop("y")).alias("syy"))
    far = at**2 - flat - tilt * at
    rss = F.greatest(F.col("syy") - F.pow("b1", 2) * s1 - F.pow("b2", 2) * s2, F.lit(0.0))
    sigma = F.sqrt(rss / (n - 3) * (1 + 1 / n + at**2 / s1 + far**2 / s2)) if n > 3 else F.lit(None).cast("double")
    return g.where(F.col("n") == n).select("site", (F.col("a") + F.col("b1") * at + F.col("b2") * far).alias("mu"), sigma.alias("sigma"), F.lit(float(n - 3)).alias("nu"))


@method("ma", "MA")
def moving_average(i: Inputs) -> DataFrame:
    return _moments(i.obs.where(F.abs(i.o.t_pred - F.col("t")) <= i.o.timescale), F.col("value"))


def _global_shift(i: Inputs, plain: DataFrame, mean_of: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """The spline of the global mean at the target, less the method's own global mean, added to each site."""
    t, y = global_series(i)
    return plain.withColumn("mu", F.col("mu") + float(kernels.spline_fit(t, y, i.o.t_pred)[0] - mean_of(t, y)))


@method("ma_globcorr")
def moving_average_corrected(i: Inputs) -> DataFrame:
    return _global_shift(i, moving_average(i), lambda t, y: y[np.abs(i.o.t_pred - t) <= i.o.timescale].mean())


def _splines(t: np.ndarray, live: np.ndarray, y: np.ndarray, at: float) -> tuple:
    """Splines of the sites of a batch, each on the times it has."""
    out = np.full((3, len(y)), np.nan)
    for places, rows in stacks.patterns(live):
        out[:, places] = stacks.spline_fit(t[rows], y[places][:, rows], at)
    return tuple(out)


@method("spline")
def spline(i: Inputs) -> DataFrame:
    at = i.o.t_pred
    return _by_batch(i.obs, ["value"], lambda t, live, y: _splines(t, live, y, at))


@method("spline_scaled")
def spline_scaled(i: Inputs) -> DataFrame:
    at = i.o.t_pred

    def fit(t, live, y):
        n = live.sum(1)
        with np.errstate(all="ignore"):
            centred = np.where(live, y - (y.sum(1) / n)[:, None], 0.0)
            s = np.sqrt((centred**2).sum(1) / (n - 1))
            mu, sigma, nu = _splines(t, live, np.where(live, y / s[:, None], 0.0), at)
        return mu * s, sigma * s, nu

    return _by_batch(i.obs, ["value"], fit)


def _ahead(i: Inputs, d: DataFrame, *columns: Column) -> DataFrame:
    """site, s: v and the columns of each site from the target backwards."""
    return d.groupBy("site").agg(F.sort_array(F.collect_list(F.struct((i.o.t_pred - F.col("t")).cast("double").alias("v"), *columns))).alias("s"))


@method("ewma", "EW")
def ewma(i: Inputs, degree: int = 0) -> DataFrame:
    s = _ahead(i, i.obs, F.col("value").alias("y")).where(F.size("s") == len(i.times))
    return innovations(s, ["v"] * degree, i.o.gamma, degree + 1)


@method("ewma_globcorr", "EW-a")
def ewma_corrected(i: Inputs, degree: int = 0) -> DataFrame:
    return _global_shift(i, ewma(i, degree), lambda t, y: float(kernels.walk_weights(np.stack([(i.o.t_pred - t) ** d for d in range(degree + 1)], -1), i.o.t_pred - t, i.o.gamma) @ y))


@method("ewma_linear")
def ewma_linear(i: Inputs) -> DataFrame:
    return ewma(i, 1)


@method("ewma_linear_globcorr")
def ewma_linear_corrected(i: Inputs) -> DataFrame:
    return ewma_corrected(i, 1)


def adaptive_walk(i: Inputs, degree: int = 0, grid: int = 33, refine: bool = True, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """site, gamma, mu, sigma, nu: `ewma` with the mixing weight of each site that is likeliest between low and high, out of a grid and, if asked, beside its best."""
    at, gammas = i.o.t_pred, np.linspace(low, high, grid)

    def fit(t, live, y):
        ahead, n = at - t, live.sum(1)
        level = np.where(live, y, 0).sum(1) / np.maximum(n, 1)
        shifted = np.where(live, y - level[:, None], 0.0)
        z = np.stack([*([np.broadcast_to(ahead, y.shape)] if degree else []), np.ones(y.shape), shifted], -1)
        gamma = stacks.adaptive_gamma(z, live, ahead, gammas, refine)
        good, mu, unc, rss = stacks.normal_equations(stacks.innovate(z, live, ahead, gamma)[0])
        nu = n - 1 - degree
        good &= n >= degree + 1
        with np.errstate(all="ignore"):
            sigma = np.sqrt(rss / np.where(nu > 0, n - degree, np.nan) * (1 - gamma + unc))
        return tuple(np.where(good, a, np.nan) for a in (gamma, mu + level, sigma, nu.astype(float)))

    return _by_batch(i.obs, ["value"], fit, ("gamma", "mu", "sigma", "nu"))


# ---- forecasts with an offset, and global coefficients ----


@method("rawmodel", "M")
def rawmodel(i: Inputs) -> DataFrame:
    return _moments(i.joined(), F.col("y") - F.col("m"), inflate=True)


def _pooled(i: Inputs, fixed: Column | None, xs: list[str]) -> DataFrame:
    """y less fixed on global coefficients of xs ('t' is time, the others are relative to the target), plus an offset by site."""
    d = i.joined().withColumn("t", F.col("t").cast("double"))
    d = d.withColumn("r", F.col("y") - fixed if fixed is not None else F.col("y"))
    b = global_coefficients(d, centred("r"), [centred(x) for x in xs])
    rest = F.col("r") - sum((float(c) * F.col(x) for c, x in zip(b, xs)), F.lit(0.0))
    return _moments(d, rest, sum(float(c) * i.o.t_pred for c, x in zip(b, xs) if x == "t"), inflate=True)


@method("rawmodel_globlinear", "MT")
def model_and_global_trend(i: Inputs) -> DataFrame:
    return _pooled(i, F.col("m"), ["t"])


@method("rawmodel_globscaled", "MS")
def globally_scaled(i: Inputs) -> DataFrame:
    return _pooled(i, None, ["m"])


@method("rawmodel_globscaled_globlinear", "MST")
def globally_scaled_and_trend(i: Inputs) -> DataFrame:
    return _pooled(i, None, ["m", "t"])


def _names(i: Inputs) -> list[str]:
    return [f"x{n + 1}" for n in range(len(i.models))]


@method("rawmultimodel_glob", "MM")
def global_multimodel(i: Inputs) -> DataFrame:
    return _pooled(i, None, _names(i))


@method("rawmultimodel_glob_globlinear", "MMT")
def global_multimodel_and_trend(i: Inputs) -> DataFrame:
    return _pooled(i, None, [*_names(i), "t"])


@method("rawmodel_scaled")
def scaled(i: Inputs) -> DataFrame:
    return _line(i.joined(), F.col("y"), F.col("m"), 0.0)


@method("rawmodel_linear")
def model_and_trend(i: Inputs) -> DataFrame:
    return _line(i.joined(), F.col("y") - F.col("m"), F.col("t").cast("double"), i.o.t_pred)


@method("rawmodel_globcorr")
def model_and_trend_of_global_mean(i: Inputs) -> DataFrame:
    d = i.joined().withColumn("r", F.col("y") - F.col("m"))
    series = d.groupBy("t").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("g"))
    b = float(series.agg(F.regr_slope("g", F.col("t").cast("double"))).first()[0])
    return _moments(d, F.col("r") - b * F.col("t"), b * i.o.t_pred, inflate=True)


# ---- forecasts with coefficients by site ----


def _models_fit(t, live, y, *xs) -> tuple:
    """Least squares on a constant and xs, which are 0 at the target."""
    x = np.stack([np.ones_like(y), *xs], -1)
    return stacks.ols(x, y, live, np.eye(x.shape[2])[:1].repeat(len(y), 0))


@method("rawmultimodel")
def multimodel(i: Inputs) -> DataFrame:
    return _by_batch(i.joined(), ["y", *_names(i)], _models_fit)


@method("ewma_model")
def ewma_model(i: Inputs, trend: bool = False) -> DataFrame:
    return innovations(_ahead(i, i.joined(), F.col("y"), F.col("m")), [*(["v"] if trend else []), "m"], i.o.gamma, 4 if trend else 3)


@method("ewma_linear_model")
def ewma_linear_model(i: Inputs) -> DataFrame:
    return ewma_model(i, True)


def _regularised(i: Inputs, xs: list[str], walk: bool) -> DataFrame:
    """Offset and trend free, coefficients of xs pulled to their global values."""
    d, at, gamma = i.joined().withColumn("v", (i.o.t_pred - F.col("t")).cast("double")), i.o.t_pred, i.o.gamma
    prior = np.append([0.0, 0.0], global_coefficients(d, F.col("y"), [F.lit(1.0), F.col("v"), *(centred(x) for x in xs)])[2:])

    def fit(t, live, y, *models):
        ahead = at - t
        x = np.stack([np.ones_like(y), np.broadcast_to(ahead, y.shape), *models], -1)

        def whiten(live, columns):
            out = np.zeros_like(columns)
            for places, rows in stacks.patterns(live):
                upper = np.linalg.cholesky(kernels.walk_covariance(ahead[rows], gamma)).T
                own = columns[places][:, rows]
                out[np.ix_(places, rows)] = np.linalg.solve(upper, own)
            return out

        return stacks.shrunk(x, y, live, np.eye(x.shape[2])[:1].repeat(len(y), 0), prior, 2, whiten=whiten if walk else None)

    return _by_batch(d, ["y", *xs], fit)


@method("model_linear_reg")
def model_linear_reg(i: Inputs) -> DataFrame:
    return _regularised(i, ["m"], False)


@method("multimodel_linear_reg")
def multimodel_linear_reg(i: Inputs) -> DataFrame:
    return _regularised(i, _names(i), False)


@method("ewma_linear_model_reg")
def ewma_linear_model_reg(i: Inputs) -> DataFrame:
    return _regularised(i, ["m"], True)


@method("ewma_linear_multimodel_reg")
def ewma_linear_multimodel_reg(i: Inputs) -> DataFrame:
    return _regularised(i, _names(i), True)


def _partially_pooled(i: Inputs, xs: list[str], trend: bool = False) -> DataFrame:
    """Empirical Bayes in two passes: fits by site give a common mean and spread of each coefficient, then sites shrink to it."""
    d, at, k = i.joined(centred=True), float(i.o.t_pred), 1 + trend + len(xs)
    columns = ["y", *xs, *(f"at_{x}" for x in xs)]

    def design(t, live, *rest):
        cols = [np.ones(live.shape), *([np.broadcast_to(t, live.shape)] if trend else []), *rest[: len(xs)]]
        some = np.arange(len(live)), live.argmax(1)
        return np.stack(cols, -1), np.stack([np.ones(len(live)), *([np.full(len(live), at)] if trend else []), *(r[some] for r in rest[len(xs) :])], -1)

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, t, live, y, *rest in series_tensors(batch, columns):
                b, v, s2 = stacks.ols_parts(design(t, live, *rest)[0], y, live)
                good = np.isfinite(s2)
                yield pa.RecordBatch.from_arrays([pa.array(list(b[good]), pa.list_(pa.float64())), pa.array(list(v[good]), pa.list_(pa.float64()))], names=["b", "v"])

    fits = gathered(d, columns).mapInArrow(first, "b array<double>, v array<double>")
    b, v = (lambda j: F.col("b")[j]), (lambda j: F.col("v")[j])
    # k times five numbers: the weighted mean of each coefficient, and its spread about that
    parts = {"w": lambda j: F.sum(1 / v(j)), "wb": lambda j: F.sum(b(j) / v(j)), "a": lambda j: F.avg(b(j)), "s": lambda j: F.var_pop(b(j)), "v": lambda j: F.avg(v(j))}
    sums = fits.agg(*(f(j).alias(f"{n}{j}") for j in range(k) for n, f in parts.items())).first()
    means = [sums[f"wb{j}"] / sums[f"w{j}"] for j in range(k)]
    spread = [sums[f"s{j}"] + (sums[f"a{j}"] - means[j]) ** 2 - sums[f"v{j}"] for j in range(k)]
    prior, scale = np.asarray(means, float), np.sqrt(np.maximum(np.asarray(spread, float), kernels.EPS))

    def fit(t, live, y, *rest):
        x, star = design(t, live, *rest)
        s2 = stacks.ols_parts(x, y, live)[2]
        known = np.where(np.isfinite(s2), s2, 1.0)
        mu, sigma, nu = stacks.shrunk(x, y, live, star, prior, 0, scale, lambda live, c: c * np.sqrt(known)[:, None, None], 1.0)
        return tuple(np.where(np.isfinite(s2), a, np.nan) for a in (mu, sigma, nu))

    return _by_batch(d, columns, fit)


@method("rawmodel_pooled")
def model_pooled(i: Inputs) -> DataFrame:
    return _partially_pooled(i, ["m"])


@method("rawmodel_linear_pooled")
def model_linear_pooled(i: Inputs) -> DataFrame:
    return _partially_pooled(i, ["m"], True)


@method("rawmultimodel_pooled")
def multimodel_pooled(i: Inputs) -> DataFrame:
    return _partially_pooled(i, _names(i))


# ---- around a smooth trend ----


def _fewer_freedoms(df: DataFrame, dof: float) -> DataFrame:
    nu = F.col("nu") + 1 - dof
    return df.select("site", "mu", (F.col("sigma") * F.sqrt(F.col("nu") / nu)).alias("sigma"), nu.alias("nu"))


@method("trend")
def trend(i: Inputs) -> DataFrame:
    d = with_trend(i.obs, ["site"], i.times, i.o.t_pred, i.o.spline_p)
    return _fewer_freedoms(_moments(d, F.col("value") - F.col("trend") + F.col("trend_pred")), i.o.dof_spline)


@method("model_trend")
def model_trend(i: Inputs) -> DataFrame:
    return _line(i.joined(detrend=True), F.col("y"), F.col("m"), 0.0)


@method("multimodel_trend")
def multimodel_trend(i: Inputs) -> DataFrame:
    return _by_batch(i.joined(detrend=True), ["y", *_names(i)], _models_fit)


@method("globalmultimodel_trend")
def global_multimodel_trend(i: Inputs) -> DataFrame:
    """The target's raw forecasts enter the mean, as in the values to match."""
    d, xs = i.joined(detrend=True), _names(i)
    c = global_coefficients(d, F.col("y"), [*map(F.col, xs), F.lit(1.0)])
    linear_part = lambda names: sum((float(b) * F.col(n) for b, n in zip(c, names)), F.lit(float(c[-1])))
    out = _fewer_freedoms(_moments(d, F.col("y") - linear_part(xs)), i.o.dof_spline)
    at = d.groupBy("site").agg(*(F.first(f"p{x}").alias(x) for x in xs)).select("site", linear_part(xs).alias("shift"))
    return out.join(at, "site").select("site", (F.col("mu") + F.col("shift")).alias("mu"), "sigma", "nu")


@method("regmultimodel_trend")
def regularised_multimodel_trend(i: Inputs) -> DataFrame:
    """Ridge to the global weights: one more row for each model."""
    d, xs, lamda = i.joined(detrend=True), _names(i), i.o.lamda
    c = global_coefficients(d, F.col("y"), [*map(F.col, xs), F.lit(1.0)])[:-1]

    def fit(t, live, y, *models):
        k, n = len(models), len(y)
        more = np.broadcast_to(np.hstack([np.zeros((k, 1)), lamda * np.eye(k)]), (n, k, k + 1))
        x = np.concatenate([np.stack([np.ones_like(y), *models], -1), more], 1)
        return stacks.ols(x, np.hstack([y, np.tile(lamda * c, (n, 1))]), np.hstack([live, np.ones((n, k), bool)]), np.eye(k + 1)[:1].repeat(n, 0))

    return _by_batch(d, ["y", *xs], fit)


@method("multimethod")
def multimethod(i: Inputs) -> DataFrame:
    """By site, the method that claims the least entropy; the earlier of equal ones. Methods that `targets` knows share one plan."""
    from foretide.plans import targets

    at = i.o.t_pred
    together = [n for n in i.o.of if n in targets.METHODS] if i.o.clim is None else []
    place = F.array_position(F.array(*map(F.lit, i.o.of)), F.col("method"))
    union = targets.predict_many(together, i.obs, i.fcst, [at], i.o, i.weights).select("site", "mu", "sigma", "nu", place.alias("place")) if together else None
    for n, name in enumerate(i.o.of):
        if name not in together:
            part = REGISTRY[name](i).select("site", "mu", "sigma", "nu", F.lit(n + 1).cast("long").alias("place"))
            union = part if union is None else union.unionByName(part)
    union = union.where(F.col("sigma").isNotNull()).withColumn("entropy", t_entropy(F.col("nu")) + F.log("sigma"))
    return union.groupBy("site").agg(F.min_by(F.struct("mu", "sigma", "nu"), F.struct("entropy", "place")).alias("b")).select("site", "b.*")


def last_values(obs: DataFrame, n: int) -> DataFrame:
    """site, mu, sigma, nu of the last n values of each site, all if it has fewer."""
    late = F.row_number().over(_site().orderBy(F.desc("t")))
    return _moments(obs.where(F.col("value").isNotNull()).withColumn("late", late).where(F.col("late") <= n), F.col("value"))


def usual(name: str, options: Options) -> Options:
    """The options of a method with its usual time scale: 15 for weights that fall off (EW), 30 for others."""
    return replace(options, timescale=15.0 if name.startswith("EW") else 30.0)


def predict_usual(names: list[str], obs: DataFrame, fcst: DataFrame | None, options: Options, weights: DataFrame | None = None) -> DataFrame:
    """site, method, mu, sigma, nu of several methods, each at its usual time scale."""
    out = None
    for name in names:
        part = predict(name, obs, fcst, usual(name, options), weights).select("site", F.lit(name).alias("method"), "mu", "sigma", "nu")
        out = part if out is None else out.unionByName(part)
    return out


def predict(name: str, obs: DataFrame, fcst: DataFrame | None, options: Options, weights: DataFrame | None = None) -> DataFrame:
    """site, mu, sigma, nu of the named method."""
    if name not in REGISTRY:
        raise ValueError(f"unknown method {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](Inputs(obs, fcst, weights, options))


#: Methods of the history alone that only look at times relative to the target, so that one plan serves many targets.
RELATIVE = ("history", "linear", "ma")


def predict_targets(name: str, obs: DataFrame, times: list[int], options: Options | None = None) -> DataFrame:
    """site, t, mu, sigma, nu of several target times, each from what was observed before it, in one scan and one shuffle."""
    if name not in RELATIVE:
        raise ValueError(f"{name} is not one of {', '.join(RELATIVE)}")
    if options is not None and options.clim is not None:
        raise ValueError("a climatology names times, and here times are relative to the target")
    each = obs.withColumn("target", F.explode(F.array(*map(F.lit, times)))).where(F.col("t") < F.col("target"))
    moved = each.select(F.struct("site", "target").alias("site"), (F.col("t") - F.col("target")).alias("t"), "value")
    out = REGISTRY[name](Inputs(moved, None, None, replace(options, t_pred=0) if options else Options(t_pred=0)))
    return out.select("site.site", F.col("site.target").alias("t"), "mu", "sigma", "nu")
