"""Studies over panels: record forecasts, trends, correlations with a permutation null, skill by climate, verification end to end."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.special import exceedance, log_score, predictive_quantile, predictive_sd, t_cdf, t_ppf
from foretide.operators import panel
from foretide.plans import predict, targets, verify


def clipped(p: Column, low: Column, high: Column) -> Column:
    """A probability inside the range of a reference forecast."""
    return F.least(F.greatest(p, low), high)


def record_scores(obs: DataFrame, trend: DataFrame, model: DataFrame, t_pred: int, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of forecasts of records at t_pred: without a trend, from a trend, from models, and from models inside the trend's range.

    obs (site, t, value), trend and model (site, mu, sigma, nu), weights (site, w and the columns by). Fractions are of weight.
    """
    past = obs.where(F.col("t") < t_pred).groupBy("site").agg(F.max("value").alias("level"), F.count("value").alias("n_before"))
    now = obs.where(F.col("t") == t_pred).select("site", "value")
    d = now.join(past, "site").join(weights, "site").where("value IS NOT NULL")
    for name, pred in (("trend", trend), ("model", model)):
        p = exceedance(F.col("mu"), F.col("sigma"), F.col("nu"), F.col("level"))
        d = d.join(pred.select("site", "mu", "sigma", "nu"), "site").withColumn(f"p_{name}", p).drop("mu", "sigma", "nu")
    d = d.withColumn("is_record", F.col("value") > F.col("level")).withColumn("p_stationary", 1 / (F.col("n_before") + 1))
    limits = d.agg(F.min("p_trend").alias("p_low"), F.max("p_trend").alias("p_high"))  # one row
    d = d.join(F.broadcast(limits), F.lit(True)).withColumn("p_clipped", clipped(F.col("p_model"), F.col("p_low"), F.col("p_high")))
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    parts = [mean(F.col("p_stationary")).alias("expected"), mean(F.col("is_record").cast("double")).alias("actual")]
    parts += [mean(log_score(F.col(f"p_{n}"), F.col("is_record"))).alias(f"nll_{n}") for n in ("stationary", "trend", "model", "clipped")]
    return d.groupBy(*by).agg(*parts) if by else d.agg(*parts)


def seasonal_trend(series: DataFrame, period: int, level: float = 0.95) -> DataFrame:
    """series (t, value) -> slope on time beside one mean for each season, and its interval, by least squares.

    The season means are taken out of both time and value first, which gives the same slope as dummies.
    """
    w = Window.partitionBy((F.col("t") % period).alias("season"))
    d = series.where("value IS NOT NULL").select((F.col("t") - F.avg("t").over(w)).alias("x"), (F.col("value") - F.avg("value").over(w)).alias("y"), (F.col("t") % period).alias("season"))
    g = d.agg(F.count("*").alias("n"), F.count_distinct("season").alias("seasons"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    g = g.withColumn("slope", F.col("xy") / F.col("xx")).withColumn("dof", (F.col("n") - F.col("seasons") - 1).cast("double"))
    half = t_ppf(F.lit((1 + level) / 2), F.col("dof")) * F.sqrt((F.col("yy") - F.col("slope") * F.col("xy")) / F.col("dof") / F.col("xx"))
    return g.select("slope", (F.col("slope") - half).alias("low"), (F.col("slope") + half).alias("high"), "dof")


def permutation(times: DataFrame, period: int, seeds: list[int]) -> DataFrame:
    """times (t) -> seed, t, other: for each seed the times of a season in an order drawn by a digest."""
    d = times.select("t", (F.col("t") % period).alias("season"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    w = Window.partitionBy("seed", "season")
    d = d.withColumn("i", F.row_number().over(w.orderBy("t"))).withColumn("j", F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", "seed", "t")))))
    return d.select("seed", "season", "i", "t").join(d.select("seed", "season", F.col("j").alias("i"), F.col("t").alias("other")), ["seed", "season", "i"]).select("seed", "t", "other")


def correlations(obs: DataFrame, fcst: DataFrame, period: int, weights: DataFrame, seeds: list[int]) -> DataFrame:
    """obs, fcst (site, t, value) -> seed (0: as they are), season, mean over sites by weight of the correlation over years."""
    own = fcst.select("t").distinct().select(F.lit(0).alias("seed"), "t", F.col("t").alias("other"))
    orders = own.unionByName(permutation(fcst.select("t").distinct(), period, seeds))
    moved = fcst.withColumnRenamed("t", "other").withColumnRenamed("value", "x").join(orders, "other")  # a row a seed for each
    d = obs.join(moved, ["site", "t"]).groupBy("seed", "site", (F.col("t") % period).alias("season")).agg(F.corr("value", "x").alias("r"))
    return d.join(weights, "site").groupBy("seed", "season").agg((F.sum(F.when(F.col("r").isNotNull(), F.col("w") * F.col("r"))) / F.sum(F.when(F.col("r").isNotNull(), F.col("w")))).alias("r"))


def correlation_study(obs: DataFrame, fcst: DataFrame, period: int, weights: DataFrame, seeds: list[int]) -> DataFrame:
    """obs (site, t, value), fcst (site, t, lag, value), weights (site, subset, w) -> lag, subset, seed (0: as they are), season, r and r_detrended.

    Means over the sites of a subset by weight of the correlations over the years of a season; detrended ones are of what
    lines in time leave of both series, which is the correlation given time. All come from one aggregate.
    """
    own = fcst.select("t").distinct().select(F.lit(0).alias("seed"), "t", F.col("t").alias("other"))
    orders = own.unionByName(permutation(fcst.select("t").distinct(), period, seeds))
    moved = fcst.select("site", "lag", F.col("t").alias("other"), F.col("value").alias("x")).join(orders, "other")  # a row a seed for each
    year = F.col("t").cast("double")
    d = obs.join(moved, ["site", "t"]).where("value IS NOT NULL AND x IS NOT NULL")
    g = d.groupBy("lag", "seed", "site", (F.col("t") % period).alias("season")).agg(F.corr("value", "x").alias("r"), F.corr("value", year).alias("ry"), F.corr("x", year).alias("rx"))
    left = (F.col("r") - F.col("ry") * F.col("rx")) / F.sqrt((1 - F.col("ry") * F.col("ry")) * (1 - F.col("rx") * F.col("rx")))
    g = g.withColumn("left", F.when((F.abs("ry") < 1) & (F.abs("rx") < 1), left))
    mean = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("w") * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))
    return g.join(weights, "site").groupBy("lag", "subset", "seed", "season").agg(mean("r").alias("r"), mean("left").alias("r_detrended"))


def forecast_maps(trend: DataFrame, model: DataFrame, clim: DataFrame) -> DataFrame:
    """trend, model (site, mu, sigma, nu), clim (site, value) -> site, differences of means, percent less spread, and classes of terciles.

    model_less_trend, trend_anomaly and model_anomaly (from the mean of clim), sd_reduction; trend_tercile and
    model_tercile (of the climatology), model_trend_tercile (of the trend's own distribution).
    """
    q = panel.quantiles(clim, ["site"], [1 / 3, 2 / 3]).select("site", F.col("quantiles")[0].alias("lower"), F.col("quantiles")[1].alias("upper"))
    mean = clim.groupBy("site").agg(F.avg("value").alias("clim_mean"))
    named = lambda d, n: d.select("site", *(F.col(c).alias(f"{n}_{c}") for c in ("mu", "sigma", "nu")))
    d = named(trend, "t").join(named(model, "m"), "site").join(q, "site").join(mean, "site")
    sd = lambda n: predictive_sd(F.col(f"{n}_sigma"), F.col(f"{n}_nu"))
    below = lambda n, level: t_cdf((level - F.col(f"{n}_mu")) / F.col(f"{n}_sigma"), F.col(f"{n}_nu"))
    classed = lambda n, low, high: verify.tercile_class(below(n, low), 1 - below(n, high))
    own = [predictive_quantile(F.col("t_mu"), F.col("t_sigma"), F.col("t_nu"), F.lit(p)) for p in (1 / 3, 2 / 3)]
    d = d.withColumn("own_lower", own[0]).withColumn("own_upper", own[1])
    lower, upper = F.col("lower"), F.col("upper")
    return d.select(
        "site", (F.col("m_mu") - F.col("t_mu")).alias("model_less_trend"), (F.col("t_mu") - F.col("clim_mean")).alias("trend_anomaly"), (F.col("m_mu") - F.col("clim_mean")).alias("model_anomaly"),
        (100 * (1 - sd("m") / sd("t"))).alias("sd_reduction"), classed("t", lower, upper).alias("trend_tercile"), classed("m", lower, upper).alias("model_tercile"), classed("m", F.col("own_lower"), F.col("own_upper")).alias("model_trend_tercile"),
    )


def map_limit(maps: DataFrame, column: str) -> DataFrame:
    """One row: the limit of a map's colours, the greater size of its 5 and 95 percent quantiles."""
    q = panel.exact_quantiles(maps.select(F.col(column).alias("value")), [], [0.05, 0.95])
    return q.select(F.greatest(F.abs(F.col("quantiles")[0]), F.abs(F.col("quantiles")[1])).alias("limit"))


def place(value: Column, edges: Column) -> Column:
    """The number of edges (sorted) at or under a value: 0 below the first."""
    return F.size(F.filter(edges, lambda e: e <= value))


def climate_classes(clim: DataFrame, n: int) -> DataFrame:
    """clim (site, mean) -> site, class: n classes of sites of about equal number by mean, from 1."""
    cuts = panel.exact_quantiles(clim.select(F.col("mean").alias("value")), [], [k / n for k in range(1, n)])
    return clim.join(F.broadcast(cuts), F.lit(True)).select("site", (1 + place(F.col("mean"), F.col("quantiles"))).alias("class"))  # one row


def conditional_skill(pred: DataFrame, placed: DataFrame, clim: DataFrame, classes: DataFrame, on: list[str], n: int = 100, floor: float = math.exp(-40)) -> DataFrame:
    """class, category, n_rows, mean_log (of the category's chance over all predictions of the class), n_seen, mean_log_seen (over those it came true for).

    pred (on, mu, sigma, nu), placed (on, category: the observed one), clim (site, mean, sd), classes (site, class).
    Chances are at least `floor`. Rows go out as one for each category and are added up where they are.
    """
    inner = verify.category_bounds(n)
    bounds = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip([float("-inf"), *inner], [*inner, float("inf")])))
    d = pred.join(placed.select(*on, F.col("category").alias("seen")), on).join(clim, "site").join(classes, "site")
    d = d.select("class", "seen", "mu", "sigma", "nu", "mean", "sd", F.posexplode(bounds).alias("i", "b"))
    below = lambda z: t_cdf((F.col("mean") + F.col("sd") * z - F.col("mu")) / F.col("sigma"), F.col("nu"))
    p = F.log(F.greatest(F.lit(floor), below(F.col("b.high")) - below(F.col("b.low"))))
    d = d.select("class", (F.col("i") + 1).alias("category"), (F.col("i") + 1 == F.col("seen")).alias("hit"), p.alias("p"))
    return d.groupBy("class", "category").agg(F.count("p").alias("n_rows"), F.avg("p").alias("mean_log"), F.count(F.when(F.col("hit"), F.col("p"))).alias("n_seen"), F.avg(F.when(F.col("hit"), F.col("p"))).alias("mean_log_seen"))


def skill_by_climate(scored: DataFrame, clim: DataFrame, n: int) -> DataFrame:
    """scored (site, error, nll, w), clim (site, mean) -> weighted scores in n classes of sites of about equal number by mean."""
    return verify.summary(scored.join(climate_classes(clim, n), "site"), ["class"])


def verify_methods(obs: DataFrame, fcst: DataFrame | None, methods: list[str], times: list[int], options: predict.Options, weights: DataFrame | None, lags: list[int] | None = None, factors: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """All methods at all target times (and leads, where fcst has a column lag): one row for each prediction, all scores as columns.

    Methods of `targets.METHODS` share one plan; any other is a plan for each target and lead. factors: logarithms of a
    method's calibration (`verify.calibrate`), by which its predictions are adjusted before they are scored.
    """
    together = [m for m in methods if m in targets.METHODS] if options.clim is None else []
    out = targets.predict_many(together, obs, fcst, times, options, weights, lags) if together else None
    for lag in lags or [None]:
        f = fcst if lag is None or fcst is None else fcst.where(F.col("lag") == lag).drop("lag")
        for t in times:
            for name in methods:
                if name not in together:
                    p = predict.predict(name, obs, f, replace(options, t_pred=t), weights).select("site", F.lit(lag).cast("int").alias("lag"), F.lit(t).alias("t"), F.lit(name).alias("method"), "mu", "sigma", "nu")
                    out = p if out is None else out.unionByName(p)
    if factors:
        of = lambda i, sign: F.coalesce(F.create_map(*(F.lit(x) for n, by in factors.items() for x in (n, math.exp(sign * by[i]))))[F.col("method")], F.lit(1.0))
        out = out.withColumns({"sigma": F.col("sigma") * of(0, 1), "nu": F.col("nu") * of(1, -1)})
    return verify.scored(out, obs.select("site", "t", "value"), ["site", "t"], weights)
