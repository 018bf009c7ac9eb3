"""Panels ready for prediction: complete observations and gap-filled forecasts of one calendar month, with their trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.operators import panel
from foretide.plans.predict import with_trend

SPLINE_P = 3e-4


def assemble_observations(monthly: DataFrame, month: int, first: int, last: int, p: float = SPLINE_P) -> DataFrame:
    """monthly (site, year, month, value) -> site, t (year), value, trend, trend_pred (at the year after the last): sites with a value in every year."""
    d = monthly.where((F.col("month") == month) & F.col("year").between(first, last)).select("site", F.col("year").alias("t"), "value")
    years = list(range(first, last + 1))
    return with_trend(panel.complete_sites(d, len(years)), ["site"], years, last + 1, p)


def assemble_forecasts(summary: DataFrame, month: int, first: int, last: int, p: float = SPLINE_P) -> DataFrame:
    """summary (site, year, month, model, vals_mean, vals_sd) -> site, t (year), model, value, sd, filled, trend: models with values at all sites, gaps filled.

    A year without any model is an error.
    """
    d = summary.where((F.col("month") == month) & F.col("year").between(first, last)).select("site", F.col("year").alias("t"), "model", F.col("vals_mean").alias("value"), F.col("vals_sd").alias("sd"))
    years = list(range(first, last + 1))
    # a model that has no row at a site lacks every value there
    pairs = d.select("site").distinct().crossJoin(F.broadcast(d.select("model").distinct()))  # models are a handful
    absent = pairs.join(d.select("site", "model").distinct(), ["site", "model"], "left_anti")
    usable = panel.usable_models(d.unionByName(absent, allowMissingColumns=True)).where(F.col("t").isNotNull())
    whole = panel.fill_missing_years(usable, years)
    trend = with_trend(whole.where(F.col("value").isNotNull()), ["site", "model"], years, last + 1, p).select("site", "model", "t", "trend")
    return whole.join(trend, ["site", "model", "t"], "left").select("site", "t", "model", "value", "sd", "filled", "trend")
