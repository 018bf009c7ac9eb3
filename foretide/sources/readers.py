"""Readers of observation and forecast data sets that were staged as tables: missing values, gaps, new grids, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.operators import panel, regrid


@dataclass(frozen=True)
class DataSet:
    start: int  # first year
    missing: str = "false"  # SQL over value: what is missing
    fill: str | None = None  # gaps: None, "row" (latitude means), "nearest" (along longitudes, then latitudes)
    least_valid: float | None = None  # share of a new cell that must be valid
    nearest: bool = False  # points go to their nearest cell and are not averaged


#: The observation data sets and how each is read.
DATA_SETS = {
    "cams": DataSet(1948, "value = -999", "nearest", 0.5),
    "ncep": DataSet(1948),
    "best": DataSet(1850, fill="row"),
    "bestland": DataSet(1750, nearest=True),
    "gpcp": DataSet(1979, "value < 0", "row"),
    "hadsst": DataSet(1850, fill="row"),
}


def read_observations(df: DataFrame, dataset: str, axes: dict[str, DataFrame], period: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """df (keys, lat, lon, value) of one data set -> the same on new cells; axes: lat and lon -> their weights (src, dst, w).

    keys tell months apart (default year, month); lat and lon are numbers of cells; period is the number of longitudes.
    """
    keys, s = keys or ["year", "month"], DATA_SETS[dataset]
    if s.nearest:
        raise ValueError(f"{dataset} holds points: read_points")
    d = df.where(F.col("year") >= s.start) if "year" in df.columns else df
    d = d.withColumn("value", F.when(~F.isnan("value") & ~F.expr(s.missing), F.col("value")))
    valid = None
    if s.fill == "row":
        d = panel.fill_row_mean(d, "lat", keys).withColumn("value", F.col("filled")).drop("filled")
    elif s.fill == "nearest":
        valid = d.withColumn("value", F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0))
        for along, of, turn in (("lon", "lat", period), ("lat", "lon", None)):
            d = panel.fill_from_neighbours(d, [*keys, of], along, turn).withColumn("value", F.col("filled")).drop("filled")
    out = regrid.regrid(d, axes, keys)
    if valid is None or s.least_valid is None:
        return out
    share = regrid.regrid(valid, axes, keys).withColumnRenamed("value", "share")
    on = [*keys, *axes]
    return out.join(share, on).select(*on, F.when(F.col("share") >= s.least_valid - 1e-12, F.col("value")).alias("value"))


def read_points(df: DataFrame, dataset: str, lats: list[float], lons: list[float], keys: list[str] | None = None) -> DataFrame:
    """df (keys, ordinal, lat, lon, value) of a data set of points -> keys, lat, lon (numbers of cells), value.

    Each point goes to its nearest cell on the axes of centres given; nothing is averaged: of the points of one cell the
    one with the greatest ordinal counts, even if its value is missing. Longitudes under 0 are turned once.
    """
    keys, s = keys or ["year", "month"], DATA_SETS[dataset]
    d = df.where(F.col("year") >= s.start) if "year" in df.columns else df
    value = F.when(~F.isnan("value") & ~F.expr(s.missing), F.col("value"))
    lon = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))
    d = d.select(*keys, "ordinal", regrid.nearest_on_axis(F.col("lat"), lats).alias("lat"), regrid.nearest_on_axis(lon, lons).alias("lon"), F.struct(value.alias("v")).alias("value"))
    return d.groupBy(*keys, "lat", "lon").agg(F.max_by("value", "ordinal").alias("value")).select(*keys, "lat", "lon", F.col("value.v").alias("value"))


def land_share(mask: DataFrame, axes: dict[str, DataFrame], n_lon: int) -> DataFrame:
    """mask (lat, lon, value: the share of land of a cell) -> site (lat * n_lon + lon), share, on new cells, between 0 and 1."""
    d = regrid.regrid(mask.where(F.col("value").isNotNull()), axes)
    return d.select((F.col("lat") * n_lon + F.col("lon")).cast("long").alias("site"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))).alias("share"))


def read_forecasts(raw: DataFrame, lag: int, zero_is_missing: bool = False) -> DataFrame:
    """raw (model, site, init_year, init_month, year, month, member, value) -> mean, spread and count of members, for targets `lag` months on."""
    y, m = panel.shift_month(F.col("year"), F.col("month"), -lag)
    d = raw.where((F.col("init_year") == y) & (F.col("init_month") == m)).withColumn("value", panel.clean_forecast(F.col("value"), zero_is_missing))
    return panel.ensemble_summary(d, ["model", "site", "year", "month"])


def transform_precipitation(obs: DataFrame, trend: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Normal scores of values, and of their trend on the same map; (keys, t, value) each."""
    scores = panel.normal_scores(obs, keys).select(*keys, "t", F.col("score").alias("value"))
    return scores, panel.transform_scores(trend, obs, keys).select(*keys, "t", F.col("score").alias("value"))
