"""Many methods, targets and leads in one plan.

One shuffle brings each site's observations, forecasts of all leads and models, and weight together. On batches of sites,
running sums over time of the products of all columns (a constant, time, its square, each model, the observation) hold
the normal equations of every target time at once: those of a target are the sums up to the time before it, a moving
window is a difference of two. A method is then a small system of a few of these columns, solved for all sites of a
batch. Methods with coefficients shared by all sites need one pass before, which adds up sums over sites for each target
and lead; targets x leads x (models + 2)^2 numbers of it reach the driver. Random walks are filtered for each target.

Results are those of `predict` for each method, target and lead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.functions import stacks
from foretide.plans.predict import MOST_CELLS, Options

#: Response less this share of the models' mean, columns, whether sites share the columns' coefficients.
LINES = {
    "history": (0, (), False), "linear": (0, ("t",), False), "quadratic": (0, ("t", "tt"), False), "ma": (0, (), False),
    "rawmodel": (1, (), False), "rawmodel_scaled": (0, ("m",), False), "rawmodel_linear": (1, ("t",), False), "rawmultimodel": (0, ("x",), False),
    "rawmodel_globlinear": (1, ("t",), True), "rawmodel_globscaled": (0, ("m",), True), "rawmodel_globscaled_globlinear": (0, ("m", "t"), True),
    "rawmultimodel_glob": (0, ("x",), True), "rawmultimodel_glob_globlinear": (0, ("x", "t"), True), "rawmodel_globcorr": (1, ("t",), True),
}
#: Columns of a random walk's design beside the constant.
WALKS = {"ewma": (), "ewma_linear": ("v",), "ewma_model": ("m",), "ewma_linear_model": ("v", "m")}
METHODS = (*LINES, *WALKS)
PAST_ONLY = ("history", "linear", "quadratic", "ma", "ewma", "ewma_linear")


class Systems:
    """Normal equations of a batch of sites for all targets of one lead."""

    def __init__(self, t: np.ndarray, y: np.ndarray, x: np.ndarray | None, w: np.ndarray, times: list[int]):
        """y: sites x times; x: sites x times x models (None: methods of the past only); NaN where missing; w: weights of sites, NaN where there is none."""
        self.t, self.y, self.x, self.w = t, y, x, w
        self.k = 0 if x is None else x.shape[2]
        self.middle = float(np.mean(times))
        u = np.broadcast_to(t - self.middle, y.shape)
        live = np.isfinite(y)
        if x is not None:
            live = live & np.isfinite(x).all(2) & np.isfinite(w)[:, None]
        self.live = live
        columns = [np.ones(y.shape), u, u * u] + ([] if x is None else [x[..., j] for j in range(self.k)]) + [y]
        z = np.where(live[..., None], np.stack(columns, -1), 0.0)
        # a constant taken off models and observations changes no slope and keeps sums small
        n = np.maximum(live.sum(1), 1)
        self.level = z.sum(1) / n[:, None]
        self.level[:, :3] = 0
        z = np.where(live[..., None], z - self.level[:, None], 0.0)
        self.sums = np.concatenate([np.zeros((len(y), 1, *[z.shape[2]] * 2)), np.cumsum(z[..., :, None] * z[..., None, :], 1)], 1)

    def upto(self, at: float, back: float | None = None) -> np.ndarray:
        """Sums over times before a target, at most `back` before it."""
        g = self.sums[:, np.searchsorted(self.t, at)]
        return g if back is None else g - self.sums[:, np.searchsorted(self.t, at - back)]

    def goal(self, at: float) -> np.ndarray:
        """The columns at a target (NaN: no forecast), the observation's zero."""
        u = at - self.middle
        out = np.zeros((len(self.y), self.sums.shape[2]))
        out[:, :3] = 1, u, u * u
        if self.k:
            i = np.searchsorted(self.t, at)
            there = i < len(self.t) and self.t[i] == at
            out[:, 3:-1] = (self.x[:, i] if there else np.nan) - self.level[:, 3:-1]
        return out

    def vectors(self, share: float, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The response and the columns of a method as combinations of the columns held."""
        p = self.sums.shape[2]
        mean = np.zeros(p)
        if self.k:
            mean[3:-1] = 1 / self.k
        response = np.eye(p)[-1] - share * mean
        known = {"t": np.eye(p)[1:2], "tt": np.eye(p)[2:3], "m": mean[None], "x": np.eye(p)[3:-1]}
        return response, np.concatenate([np.zeros((0, p)), *(known[c] for c in columns)])


def centred(g: np.ndarray) -> np.ndarray:
    """Sums of products about the means."""
    n = np.maximum(g[:, :1, :1], 1)
    return g - g[:, :, :1] * g[:, :1, :] / n


def line(s: Systems, at: float, g: np.ndarray, response: np.ndarray, columns: np.ndarray, inflate: bool = True) -> stacks.Fits:
    """Least squares of a response (a combination) on columns, predicted at a target, what was taken off the response put back."""
    n, c, goal = g[:, 0, 0], centred(g), s.goal(at)
    means = g[:, 0] / np.maximum(n, 1)[:, None]
    a, b, syy = np.einsum("ip,spq,jq->sij", columns, c, columns), np.einsum("ip,spq,q->si", columns, c, response), np.einsum("p,spq,q->s", response, c, response)
    size = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0))
    with np.errstate(all="ignore"):
        scaled = a / size[:, :, None] / size[:, None]
        good = (n > len(columns)) & np.isfinite(scaled).all((1, 2)) & np.isfinite(goal).all(1)
        scaled = np.where(good[:, None, None], scaled, np.eye(len(columns)))
        if len(columns):
            good &= np.linalg.eigvalsh(scaled)[:, 0] > stacks.DEPENDENT
            scaled = np.where(good[:, None, None], scaled, np.eye(len(columns)))
        far = ((goal - means) @ columns.T) / size
        solved = np.linalg.solve(scaled, np.stack([b / size, far], -1))
        nu = n - 1 - len(columns)
        rss = np.maximum(syy - (b / size * solved[..., 0]).sum(1), 0)
        lever = (1 / n + (far * solved[..., 1]).sum(1)) if inflate else 0
        sigma = np.sqrt(rss / np.where(nu > 0, nu, np.nan) * (1 + lever))
        mu = means @ response + (far * solved[..., 0]).sum(1) - goal[:, :-1] @ response[:-1]
    mu = mu + s.level[:, -1]
    return np.where(good, mu, np.nan), np.where(good, sigma, np.nan), np.where(good, nu, np.nan)


def walk(s: Systems, at: float, columns: tuple[str, ...], gamma: float) -> stacks.Fits:
    """White noise mixed with a random walk that is 0 at the target: products of innovations, step by step from the target."""
    before = np.flatnonzero(s.t < at)
    goal = s.goal(at)
    mean = (s.x - s.level[:, None, 3:-1] - goal[:, None, 3:-1])[:, before].mean(2) if s.k else None
    ahead = at - s.t[before]
    y = s.y[:, before] - s.level[:, -1:]
    z = np.stack([*({"v": np.broadcast_to(ahead, y.shape), "m": mean}[c] for c in columns), np.ones(y.shape), y], -1)
    total, _ = stacks.innovate(z, s.live[:, before], ahead, gamma)
    good, level, unc, rss = stacks.normal_equations(total)
    n, k = s.live[:, before].sum(1), len(columns) + 1
    good &= (n >= k) & np.isfinite(goal).all(1)
    with np.errstate(all="ignore"):
        nu = n - k - (1 if s.k else 0)
        sigma = np.sqrt(rss / np.where(nu > 0, n - (k - 1), np.nan) * (1 - gamma + unc))
    return np.where(good, level + s.level[:, -1], np.nan), np.where(good, sigma, np.nan), np.where(good, nu, np.nan)


def gather(obs: DataFrame, fcst: DataFrame | None, weights: DataFrame | None, models: list[str], lags: list, last: int) -> DataFrame:
    """site, s: structs of time, slot (-1: weight, 0: observation, then lead by lead the models) and value."""
    value = F.col("value").cast("double").alias("value")
    rows = obs.where(F.col("t") < last).select("site", "t", F.lit(0).alias("slot"), value)
    if fcst is not None:
        lag = F.array_position(F.array(*map(F.lit, lags)), F.col("lag")) - 1 if lags != [None] else F.lit(0)
        slot = 1 + lag * len(models) + F.array_position(F.array(*map(F.lit, models)), F.col("model")) - 1
        rows = rows.unionByName(fcst.where(F.col("t") <= last).select("site", "t", slot.cast("int").alias("slot"), value).where("slot > 0"))
    if weights is not None:
        rows = rows.unionByName(weights.select("site", F.lit(last).alias("t"), F.lit(-1).alias("slot"), F.col("w").cast("double").alias("value")))
    return rows.where(F.col("value").isNotNull()).groupBy("site").agg(F.collect_list(F.struct("t", "slot", "value")).alias("s"))


def systems(batch, n_models: int, lags: list, times: list[int], weighted: bool) -> Iterator[tuple]:
    """Parts of a batch: first site, number of sites, and for each lead the systems of the past only and of the models."""
    lists, start = batch.column("s"), 0
    sizes = np.diff(lists.offsets.to_numpy()[: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
    width = (n_models + 4) ** 2
    while start < batch.num_rows:
        n = max(1, min(batch.num_rows - start, MOST_CELLS // max(1, width * int(sizes[start:].max()))))
        flat = lists.slice(start, n).flatten()
        own = np.repeat(np.arange(n), sizes[start : start + n])
        at, slot, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "slot", "value"))
        w = np.full(n, np.nan if weighted else 1.0)
        w[own[slot < 0]] = value[slot < 0]
        some = slot >= 0
        t, place = np.unique(np.concatenate([at[some], np.asarray(times, at.dtype)]), return_inverse=True)
        cells = np.full((n, len(t), 1 + n_models * len(lags)), np.nan)
        cells[own[some], place[: some.sum()], slot[some]] = value[some]
        y = cells[..., 0]
        past = Systems(t.astype(float), y, None, w, times)
        both = [Systems(t.astype(float), y, cells[..., 1 + j * n_models : 1 + (j + 1) * n_models], w, times) if n_models else None for j in range(len(lags))]
        yield start, n, past, both
        start += n


def shared(frames: DataFrame, names: list[str], n_models: int, lags: list, times: list[int], weighted: bool) -> dict:
    """(method, target, place of the lead) -> coefficients over all sites, from sums with squared weights."""
    p = n_models + 4

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, _, both in systems(batch, n_models, lags, times, weighted):
                for j, s in enumerate(both):
                    for at in times:
                        there = np.isfinite(s.goal(at)).all(1)
                        w = np.where(there, np.nan_to_num(s.w), 0.0)
                        g = np.einsum("s,spq->pq", w * w, centred(s.upto(at)))
                        # the series of the mean over sites of what models leave, by time
                        before = s.t < at
                        r = s.y[:, before] - s.x[:, before].mean(2) + (s.goal(at)[:, 3:-1] + s.level[:, 3:-1]).mean(1)[:, None]
                        ok = s.live[:, before] & there[:, None]
                        top, low = np.where(ok, w[:, None] * r, 0.0).sum(0), (ok * w[:, None]).sum(0)
                        t = s.t[before].astype(int)
                        rows = [(at, j, 0, i, v) for i, v in enumerate(g.ravel().tolist())] + [(at, j, kind, k, v) for kind, xs in ((1, top), (2, low)) for k, v in zip(t.tolist(), xs.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["t", "lead", "kind", "i", "v"])

    sums = frames.mapInArrow(part, "t int, lead int, kind int, i int, v double").groupBy("t", "lead", "kind", "i").agg(F.sum("v").alias("v"))
    found = {(r["t"], r["lead"], r["kind"], r["i"]): r["v"] for r in sums.collect()}  # targets x leads x ((models + 4)^2 + 2 x times)
    out, s = {}, Systems(np.zeros(1), np.zeros((1, 1)), np.zeros((1, 1, n_models)), np.ones(1), times)
    for at in times:
        for j in range(len(lags)):
            g = np.asarray([found.get((at, j, 0, i), 0.0) for i in range(p * p)]).reshape(p, p)
            for name in names:
                if name == "rawmodel_globcorr":
                    low = {i: v for (a, b, kind, i), v in found.items() if (a, b, kind) == (at, j, 2) and v > 0}
                    t = np.asarray(sorted(low), float)
                    m = np.asarray([found[at, j, 1, i] / low[i] for i in sorted(low)])
                    x = t - t.mean() if len(t) else t
                    out[name, at, j] = np.asarray([(x * m).sum() / (x * x).sum() if len(t) > 1 else np.nan])
                    continue
                share, columns, _ = LINES[name]
                response, c = s.vectors(share, columns)
                a, b = c @ g @ c.T, c @ g @ response
                size = np.sqrt(np.maximum(np.diag(a), 0))
                size[size == 0] = 1
                out[name, at, j] = np.linalg.lstsq(a / np.outer(size, size), b / size, rcond=None)[0] / size
    return out


def predict_many(names: list[str], obs: DataFrame, fcst: DataFrame | None, times: list[int], options: Options | None = None, weights: DataFrame | None = None, lags: list[int] | None = None) -> DataFrame:
    """site, lag, t, method, mu, sigma, nu of each method (of METHODS) at each target time and lead.

    obs (site, t, value), fcst (site, t, model, value, and lag where leads are given), weights (site, w).
    """
    if unknown := [n for n in names if n not in METHODS]:
        raise ValueError(f"not among {', '.join(METHODS)}: {', '.join(unknown)}")
    o = options or Options(t_pred=0)
    if o.clim is not None:
        raise ValueError("a climatology names times, and here times are relative to the target")
    leads, last = list(lags) if lags else [None], max(times)
    use = fcst is not None and any(n not in PAST_ONLY for n in names)
    if not use and any(n not in PAST_ONLY for n in names):
        raise ValueError("methods with models need forecasts")
    models = sorted(r[0] for r in fcst.select("model").distinct().collect()) if use else []
    # the past only: the same at every lead
    frames = gather(obs, fcst if use else None, weights if use else None, models, leads, last)
    weighted, k = weights is not None, len(models)
    coefficients = shared(frames, [n for n in names if n in LINES and LINES[n][2]], k, leads, times, weighted) if any(n in LINES and LINES[n][2] for n in names) else {}
    # methods that leave out sites with gaps: the number of times before each target
    seen = sorted(r[0] for r in obs.where(F.col("value").isNotNull() & (F.col("t") < last)).select("t").distinct().collect()) if {"quadratic", "ewma", "ewma_linear"} & set(names) else []
    before = {at: sum(x < at for x in seen) for at in times}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def fit(name: str, at: int, j: int, past: Systems, both: list):
            s = past if name in PAST_ONLY else both[j]
            if name in WALKS:
                out = walk(s, at, WALKS[name], o.gamma)
            else:
                share, columns, common = LINES[name]
                g = s.upto(at, o.timescale if name == "ma" else None)
                response, c = s.vectors(share, columns)
                if common:
                    response, c = response - coefficients[name, at, j] @ c, c[:0]
                out = line(s, at, g, response, c, inflate=name not in ("history", "ma"))
            if name in ("quadratic", "ewma", "ewma_linear"):
                whole = s.upto(at)[:, 0, 0] == before[at]
                out = tuple(np.where(whole, a, np.nan) for a in out)
            return out

        for batch in batches:
            for start, n, past, both in systems(batch, k, leads, times, weighted):
                sites = batch.column("site").slice(start, n)
                for j, lag in enumerate(leads):
                    for at in times:
                        for name in names:
                            out = fit(name, at, j, past, both)
                            some = pa.array(np.isfinite(out[0]))
                            part = [sites, pa.array([lag] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array([name] * n), *(pa.array(x, from_pandas=True) for x in out)]
                            yield pa.RecordBatch.from_arrays(part, names=["site", "lag", "t", "method", "mu", "sigma", "nu"]).filter(some)

    return frames.mapInArrow(run, f"site {dict(obs.dtypes)['site']}, lag int, t int, method string, mu double, sigma double, nu double")
