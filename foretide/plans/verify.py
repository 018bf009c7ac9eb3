"""Scores of predictions, calibration, category and probability products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions import kernels
from foretide.functions.special import t_cdf, t_crps, t_entropy, t_logpdf, t_ppf_value
from foretide.operators import panel


def scored(pred: DataFrame, obs: DataFrame, on: list[str], weights: DataFrame | None = None) -> DataFrame:
    """pred (on, mu, sigma, nu) with obs (on, value): one row for each prediction, all scores as columns."""
    d = pred.join(obs.withColumnRenamed("value", "y"), on).where("sigma > 0 AND y IS NOT NULL")
    d = d.join(weights, "site") if weights is not None else d.withColumn("w", F.lit(1.0))
    z = (F.col("y") - F.col("mu")) / F.col("sigma")
    return d.withColumns({"error": F.col("mu") - F.col("y"), "z": z}).withColumns({
        "nll": -t_logpdf(F.col("z"), F.col("nu")) + F.log("sigma"),
        "crps": F.col("sigma") * t_crps(F.col("z"), F.col("nu")),
        "entropy": t_entropy(F.col("nu")) + F.log("sigma"),
        "pit": t_cdf(F.col("z"), F.col("nu")),
    })


def _mean(c: Column, w: Column) -> Column:
    there = c.isNotNull()
    return F.sum(F.when(there, w * c)) / F.sum(F.when(there, w))


def summary(s: DataFrame, by: list[str], weighted: bool = True) -> DataFrame:
    """RMSE, bias, mean log score, CRPS and predictive entropy by the columns given (maps: by site, unweighted; series: by time)."""
    w = F.col("w") if weighted else F.lit(1.0)
    parts = [F.sqrt(_mean(F.col("error") * F.col("error"), w)).alias("rmse"), _mean(F.col("error"), w).alias("bias"), _mean(F.col("nll"), w).alias("nll"), _mean(F.col("crps"), w).alias("crps"), _mean(F.col("entropy"), w).alias("predent")]
    return s.groupBy(*by).agg(*parts) if by else s.agg(*parts)


def pit_histogram(s: DataFrame, by: list[str], bins: int = 100) -> DataFrame:
    bin_ = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(bins * F.col("pit")).cast("int")))
    return s.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))


def ks_statistic(s: DataFrame, by: list[str], slices: int = 64) -> DataFrame:
    """Kolmogorov-Smirnov distance of pit to the uniform distribution, and its asymptotic p.

    Equal values are counted first. Ranks come in two steps: slices of about as many values each, by approximate
    quantiles of a group, then running counts within a slice, so that no task sorts all rows wherever pit gathers.
    """
    each = s.where("pit IS NOT NULL").groupBy(*by, "pit").agg(F.count("*").alias("m"))
    bounds = F.percentile_approx("pit", [i / slices for i in range(1, slices)], 100 * slices).alias("bounds")
    limits = each.groupBy(*by).agg(bounds) if by else each.agg(bounds)  # one row a group
    placed = each.join(limits, by) if by else each.crossJoin(F.broadcast(limits))
    d = placed.select(*by, "pit", "m", F.size(F.filter("bounds", lambda b: b < F.col("pit"))).alias("slice"))
    counts = d.groupBy(*by, "slice").agg(F.sum("m").alias("of_slice"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("before", F.coalesce(F.sum("of_slice").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("of_slice").over(w)).drop("of_slice")
    r = d.join(counts, [*by, "slice"])  # at most `slices` rows a group
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(*by, "slice").orderBy("pit").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("upto", upto).withColumn("gap", F.greatest(F.col("upto") / F.col("total") - F.col("pit"), F.col("pit") - (F.col("upto") - F.col("m")) / F.col("total")))
    agg = [F.max("gap").alias("ks"), F.first("total").alias("n")]
    g = r.groupBy(*by).agg(*agg) if by else r.agg(*agg)
    x = F.pow("ks", 2) * F.col("n")
    return g.withColumn("kp", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum(((-1) ** (k - 1) * F.exp(-2 * k * k * x) for k in range(1, 21)), F.lit(0.0)))))


# ---- categories ----


def category_bounds(n: int = 100) -> list[float]:
    """Inner bounds of n equally likely categories of a t with n - 1 degrees of freedom."""
    return [t_ppf_value(i / n, n - 1) for i in range(1, n)]


def climatology_category(obs: DataFrame, clim: DataFrame, n: int = 100) -> DataFrame:
    """obs (site, value), clim (site, mean, sd) -> the category of each value, 1 to n, and its bounds in units of the value."""
    d = obs.join(clim, "site").withColumn("category", F.greatest(F.lit(1), F.ceil(n * t_cdf((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(float(n - 1)))).cast("int")))
    b = F.array(F.lit(float("-inf")), *map(F.lit, category_bounds(n)), F.lit(float("inf")))
    edge = lambda at: F.col("mean") + F.col("sd") * F.element_at(b, at)
    return d.withColumn("low", edge(F.col("category"))).withColumn("high", edge(F.col("category") + 1))


def _cdf_at(level: Column) -> Column:
    """Infinite levels are fine: the integral then reaches its full range."""
    return t_cdf((level - F.col("mu")) / F.col("sigma"), F.col("nu"))


def _weighted(d: DataFrame, weights: DataFrame | None) -> DataFrame:
    return d.withColumn("w", F.lit(1.0)) if weights is None else d.join(weights.select("site", "w"), "site")


def masked_weights(weights: DataFrame, mask: DataFrame, inside: bool = True) -> DataFrame:
    """weights (site, w) times the share of each site that a mask (site, share) covers, or the rest of it; sites left without weight go."""
    share = F.coalesce("share", F.lit(0.0))
    return weights.join(mask, "site", "left").select("site", (F.col("w") * (share if inside else 1 - share)).alias("w")).where("w > 0")


def category_scores(pred: DataFrame, placed: DataFrame, on: list[str], by: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Mean probability and log score of the observed category, by weights of sites."""
    d = _weighted(pred.join(placed, on), weights).withColumn("p", _cdf_at(F.col("high")) - _cdf_at(F.col("low")))
    return d.groupBy(*by, "category").agg(_mean(F.col("p"), F.col("w")).alias("prob"), _mean(-F.log("p"), F.col("w")).alias("nll"), F.count("*").alias("n"))


def forecast_frequencies(pred: DataFrame, clim: DataFrame, by: list[str], n: int = 100, weights: DataFrame | None = None) -> DataFrame:
    """Mean probability of each category under the predictions, over sites by weight, then over times; thresholds are an array in the row, not a cross join."""
    levels = F.array(*map(F.lit, category_bounds(n)))
    times = ["t"] if "t" in pred.columns else []
    d = _weighted(pred.join(clim, "site"), weights).select(*by, *times, "w", "mu", "sigma", "nu", "mean", "sd", F.posexplode(levels).alias("i", "level"))
    below = t_cdf((F.col("mean") + F.col("sd") * F.col("level") - F.col("mu")) / F.col("sigma"), F.col("nu"))
    each = d.groupBy(*by, *times, (F.col("i") + 1).alias("category")).agg(_mean(below, F.col("w")).alias("below"))
    g = each.groupBy(*by, "category").agg(F.avg("below").alias("below"))
    last = g.select(*by).distinct().select(*by, F.lit(n).alias("category"), F.lit(1.0).alias("below"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("category")
    return g.unionByName(last).select(*by, "category", (F.col("below") - F.lag("below", 1, 0.0).over(w)).alias("freq"))


def observed_frequencies(placed: DataFrame, n: int = 100) -> DataFrame:
    """Share of each category, empty ones included."""
    every = placed.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("category"))
    g = placed.groupBy("category").agg(F.count("*").alias("n"))
    total = Window.partitionBy(F.lit(0))
    return every.join(g, "category", "left").select("category", (F.coalesce("n", F.lit(0)) / F.sum("n").over(total)).alias("freq"))  # n rows


# ---- calibration ----


def calibrate(s: DataFrame, bins: int = 100) -> tuple[float, float]:
    """Logarithms of factors of sigma and of 1 / nu that make the PIT histogram flattest; one job for each batch of candidates."""
    base = s.select("z", "nu").cache()

    def cost(candidates: list[np.ndarray]) -> list[float]:
        tried = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(np.exp(c[0]))).alias("fs"), F.lit(float(np.exp(c[1]))).alias("fn")) for i, c in enumerate(candidates))))
        d = base.select("z", "nu", tried.alias("c")).withColumn("pit", t_cdf(F.col("z") / F.col("c.fs"), F.col("nu") / F.col("c.fn")))
        rows = pit_histogram(d, ["c.i"], bins).collect()  # candidates x bins
        hist = np.zeros((len(candidates), bins))
        for r in rows:
            hist[r["i"], r["bin"] - 1] = r["n"]
        return ((hist - hist.sum(1, keepdims=True) / bins) ** 2).sum(1).tolist()

    best = kernels.nelder_mead(cost, np.asarray([0.0, 0.3]))
    base.unpersist()
    return float(best[0]), float(best[1])


def adjusted(pred: DataFrame, log_sigma: float, log_nu: float) -> DataFrame:
    return pred.withColumn("sigma", F.col("sigma") * float(np.exp(log_sigma))).withColumn("nu", F.col("nu") / float(np.exp(log_nu)))


# ---- products ----


def tercile_class(below: Column, above: Column) -> Column:
    """-6 to 6: how sure the lower (negative) or the upper tercile is, from 0.4 to 0.9; 0 otherwise."""
    out = F.lit(0)
    for k in range(1, 7):  # a later condition is the stricter one
        level = 0.3 + k / 10
        out = F.when((below > level) & (below > above), -k).when((above > level) & (above > below), k).otherwise(out)
    return out


def tercile_map(pred: DataFrame, terciles: DataFrame) -> DataFrame:
    """terciles (site, lower, upper) -> site, below, above, tercile."""
    d = pred.join(terciles, "site").withColumn("below", _cdf_at(F.col("lower"))).withColumn("above", 1 - _cdf_at(F.col("upper")))
    return d.select("site", "below", "above", tercile_class(F.col("below"), F.col("above")).alias("tercile"))


def values_cdf(pred: DataFrame, values: list[float]) -> DataFrame:
    """Probability of not exceeding each value."""
    return pred.select("*", F.explode(F.array(*map(F.lit, values))).alias("value")).withColumn("p", _cdf_at(F.col("value")))


def quantiles_cdf(pred: DataFrame, clim: DataFrame, qs: list[float], factors: tuple[float, float] | None = None) -> DataFrame:
    """Probability of not exceeding the quantiles of each site's climatology, clim (site, value).

    factors: logarithms of calibration (`calibrate`). Here, as in the values to be matched, the second multiplies the
    degrees of freedom, where `adjusted` divides them.
    """
    d = pred if factors is None else adjusted(pred, factors[0], -factors[1])
    at = panel.quantiles(clim, ["site"], qs).select("site", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("quantiles").alias("value"))).alias("z")).select("site", "z.q", "z.value")
    return d.join(at, "site").withColumn("p", _cdf_at(F.col("value")))
