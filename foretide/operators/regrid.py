"""Redistribution between grids: overlap weights of one axis after the other, as joins with small axis tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.functions.special import haversine
from foretide.sources.hyperslab import shared_folder


def axis_cells(spark: SparkSession, limits: list[float]) -> DataFrame:
    """idx, lo, hi of the cells between limits, from 0."""
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(limits, limits[1:]))], "idx int, lo double, hi double")


def midpoint_limits(centres: list[float], first: float, last: float) -> list[float]:
    return [first, *((a + b) / 2 for a, b in zip(centres, centres[1:])), last]


def cell_limits(axis: DataFrame, first: float, last: float, keys: list[str] | None = None) -> DataFrame:
    """axis (keys, idx, centre) -> lo and hi of each cell: midpoints of neighbours, and first and last at the ends."""
    w = Window.partitionBy(*keys).orderBy("idx") if keys else Window.orderBy("idx")  # an axis is short
    lo = F.coalesce((F.lag("centre").over(w) + F.col("centre")) / 2, F.lit(float(first)))
    return axis.withColumn("lo", lo).withColumn("hi", F.coalesce((F.lead("centre").over(w) + F.col("centre")) / 2, F.lit(float(last))))


def nearest_index(x: Column, first: float, step: float, n: int) -> Column:
    """The place, from 0, of the nearest of n evenly spaced centres."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round((x - first) / step).cast("int")))


def nearest_on_axis(x: Column, centres: list[float]) -> Column:
    """The place, from 0, of the nearest of unevenly spaced centres (rising or falling), between two of them by the straight line; ends hold beyond."""
    sign = 1.0 if centres[-1] >= centres[0] else -1.0
    rising = [sign * c for c in centres]
    axis, z = F.array(*map(F.lit, rising)), sign * x
    i = F.greatest(F.lit(1), F.least(F.lit(len(rising) - 1), F.size(F.filter(axis, lambda c: c <= z))))
    low, high = F.element_at(axis, i), F.element_at(axis, i + 1)
    return F.greatest(F.lit(0), F.least(F.lit(len(rising) - 1), F.floor(i - 1 + (z - low) / (high - low) + 0.5).cast("int")))


def sine_limits(limits: list[float]) -> list[float]:
    """Latitude limits as sines, so that differences are areas."""
    return np.sin(np.radians(limits)).tolist()


def overlap_weights(old: DataFrame, new: DataFrame, period: float | None = None) -> DataFrame:
    """src, dst, w: the share of each new cell that an old cell covers, of all that is covered. Axis tables are small."""
    o = old.select(F.col("idx").alias("src"), "lo", "hi")
    if period:
        o = o.withColumn("_c", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("src", (F.col("lo") + F.col("_c") * period).alias("lo"), (F.col("hi") + F.col("_c") * period).alias("hi"))
    n = new.select(F.col("idx").alias("dst"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    both = o.join(F.broadcast(n), (F.col("lo") < F.col("nhi")) & (F.col("nlo") < F.col("hi")))
    part = both.groupBy("src", "dst").agg(F.sum(F.least("hi", "nhi") - F.greatest("lo", "nlo")).alias("part"))
    whole = part.groupBy("dst").agg(F.sum("part").alias("whole"))
    return part.join(F.broadcast(whole), "dst").select("src", "dst", (F.col("part") / F.col("whole")).alias("w"))


def regrid(df: DataFrame, axes: dict[str, DataFrame], keys: list[str] | None = None, value: str = "value", least_valid: float | None = None) -> DataFrame:
    """df (keys, axis columns, value) -> the same on new cells; axes: axis column -> its weights (src, dst, w).

    A missing value makes a new cell missing, unless least_valid is given: then valid parts are averaged and a cell is
    missing where they are a smaller share than that.
    """
    keys, d, weight = keys or [], df, F.lit(1.0)
    for axis, w in axes.items():
        d = d.join(F.broadcast(w.select(F.col("src").alias(axis), F.col("dst").alias(f"_{axis}"), F.col("w").alias(f"_w_{axis}"))), axis)
        weight = weight * F.col(f"_w_{axis}")
    there = F.col(value).isNotNull()
    g = d.withColumn("_w", weight).groupBy(*keys, *(F.col(f"_{a}").alias(a) for a in axes)).agg(
        F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum(F.when(there, F.col("_w")).otherwise(0.0)).alias("_valid"), F.sum("_w").alias("_all")
    )
    if least_valid is None:
        out = F.when(F.col("_valid") > F.col("_all") * (1 - 1e-12), F.col("_s"))
    else:
        out = F.when((F.col("_valid") >= least_valid * F.col("_all")) & (F.col("_valid") > 0), F.col("_s") / F.col("_valid"))
    return g.select(*keys, *axes, out.alias(value))


def weighted_regrid(df: DataFrame, axes: dict[str, DataFrame], weight: str, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Regridded value * weight over regridded weight."""
    top = regrid(df.withColumn(value, F.col(value) * F.col(weight)), axes, keys, value)
    low = regrid(df, axes, keys, weight)
    on = [*(keys or []), *axes]
    return top.join(low, on).select(*on, (F.col(value) / F.col(weight)).alias(value))


def bands_weights(weights: dict[int, DataFrame]) -> DataFrame:
    """Weights of an axis that differs from band to band: band, src, dst, w."""
    out = None
    for band, w in weights.items():
        w = w.withColumn("band", F.lit(band))
        out = w if out is None else out.unionByName(w)
    return out


def to_equal_area(df: DataFrame, lat: DataFrame, lon_by_band: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latitudes first, then longitudes by the weights of each band: band, point, value."""
    keys = keys or []
    d = regrid(df, {"lat": lat}, [*keys, "lon"]).withColumnRenamed("lat", "band")
    j = d.join(F.broadcast(lon_by_band.withColumnRenamed("src", "lon")), ["band", "lon"])
    return j.groupBy(*keys, "band", F.col("dst").alias("point")).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def from_equal_area(df: DataFrame, lat: DataFrame, lon_by_band: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Points (band, point) to longitudes first, then bands to latitudes: lat, lon, value."""
    keys = keys or []
    j = df.join(F.broadcast(lon_by_band.withColumnRenamed("src", "point")), ["band", "point"])
    d = j.groupBy(*keys, "band", F.col("dst").alias("lon")).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))
    return regrid(d.withColumnRenamed("band", "lat"), {"lat": lat}, [*keys, "lon"])


def _cube(lat: Column, lon: Column, side: float) -> list[Column]:
    """The cube of space that a place on the unit sphere lies in; cubes know neither poles nor a date line."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.floor(c / side) for c in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def _near(points: DataFrame, grid: DataFrame, reach: float) -> DataFrame:
    """points (id, lat, lon) with each grid cell within `reach` degrees: id, d and what the grid holds beside lat and lon.

    An equi-join of cubes: cells go to 27 cubes each, a point to one, so that one task meets all the cells of a point.
    """
    side = _side(reach)
    p = points.select("id", "lat", "lon", *(c.alias(f"c{i}") for i, c in enumerate(_cube(F.col("lat"), F.col("lon"), side))))
    steps = F.explode(F.array(*(F.array(*map(F.lit, at)) for at in itertools.product((-1, 0, 1), repeat=3))))
    held = [c for c in grid.columns if c not in ("lat", "lon")]
    g = grid.select(*held, F.col("lat").alias("glat"), F.col("lon").alias("glon"), steps.alias("_s"))
    g = g.select(*held, "glat", "glon", *((c + F.col("_s")[i]).alias(f"c{i}") for i, c in enumerate(_cube(F.col("glat"), F.col("glon"), side))))
    d = haversine(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"))
    # a merge join at every size: cells times 27 have no bound that a broadcast could keep to
    return p.join(g.hint("merge"), ["c0", "c1", "c2"]).select("id", *held, d.alias("d")).where(F.col("d") <= reach)


def _side(reach: float) -> float:
    """The side of cubes of which places within `reach` degrees are the same or neighbours."""
    return 2 * math.sin(math.radians(min(reach, 180.0)) / 2) * (1 + 1e-9)


#: Places that the fullest cube holds at most, where the search for nearest cells begins.
MOST_PLACES = 16


def _first_reach(places: DataFrame, reach: float) -> float:
    """The largest of reach, reach / 3, reach / 9, ... whose cubes hold at most MOST_PLACES places, as one aggregate of a row for each of them."""
    tried = [reach / 3**k for k in range(12)]
    cubes = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(c.alias(f"c{i}") for i, c in enumerate(_cube(F.col("lat"), F.col("lon"), _side(r))))) for k, r in enumerate(tried))))
    full = places.select(cubes.alias("c")).select("c.*").groupBy("k", "c0", "c1", "c2").count().groupBy("k").agg(F.max("count").alias("most")).collect()
    return max((tried[r["k"]] for r in full if r["most"] <= MOST_PLACES), default=tried[-1] if full else reach)


def nearest_cell(points: DataFrame, grid: DataFrame, reach: float = 2.0) -> DataFrame:
    """points (id, lat, lon) with the site of the nearest grid cell, the smaller site of equally near ones.

    Cells in reach come from an equi-join; points that have none ask again with three times the reach, until it spans the
    sphere. The first reach is `reach` or, on a dense grid, so much smaller that a cube holds few cells: a point meets the
    cells of 27 cubes, however many the grid has. Sites of one place are one cell. What each round found is written once,
    so no round repeats those before it.
    """
    spark = points.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        df.write.parquet(path := shared_folder(spark))
        return spark.read.schema(df.schema).parquet(path)

    places = stored(grid.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.min("site").alias("site")))
    reach, best = _first_reach(places, reach), None
    open_ = points.select("id", "lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    while True:
        near = stored(_near(open_, places, reach).groupBy("id").agg(F.min_by("site", F.struct("d", "site")).alias("site"), F.min("d").alias("distance")))
        best = near if best is None else best.unionByName(near)
        if reach >= 180:
            return best
        open_, reach = stored(open_.join(near.select("id"), "id", "left_anti")), min(180.0, 3 * reach)
        if open_.isEmpty():
            return best


def distance_weighted(points: DataFrame, grid: DataFrame, values: DataFrame, scale: float = 1.0, radius: float = 8.0, nearest: float = 1.5, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Means of site values (one or several columns, such as those of predictions) around each point with weights exp(-distance/scale) within a radius, where some site is near.

    Sites that lack any of the columns take no part. Sites of one place are one cell with their number and sums, which
    it brings to its points: the pairs are summed where they are met and never written, one row a point is.
    """
    there = values.select("site", *columns).dropna(subset=list(columns))
    sums = [F.sum(c).alias(f"_{i}") for i, c in enumerate(columns)]
    places = grid.select("site", "lat", "lon").join(there, "site").groupBy("lat", "lon").agg(*sums, F.count("*").alias("_n"))
    near = _near(points, places, radius).where(F.col("d") < radius).withColumn("_w", F.exp(-F.col("d") / scale))
    means = [(F.sum(F.col("_w") * F.col(f"_{i}")) / F.sum(F.col("_w") * F.col("_n"))).alias(c) for i, c in enumerate(columns)]
    return near.groupBy("id").agg(*means, F.min("d").alias("closest")).where(F.col("closest") <= nearest).drop("closest")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a place lies in a box of latitudes and longitudes, ends included; a box may run over the date line (west > east)."""
    turn = lambda x: F.pmod(x, F.lit(360.0))
    w, e = west % 360.0, east % 360.0
    across = (turn(lon) >= w) & (turn(lon) <= e) if w <= e else (turn(lon) >= w) | (turn(lon) <= e)
    return (lat >= south) & (lat <= north) & (across if east - west < 360 else F.lit(True))


def region(cells: DataFrame, box: tuple[float, float, float, float], least_land: float | None = None) -> DataFrame:
    """cells (site, lat, lon and, if land counts, share) -> the sites in a box (south, north, west, east) with at least a share of land."""
    d = cells.where(in_box(F.col("lat"), F.col("lon"), *box))
    return (d if least_land is None else d.where(F.col("share") >= least_land)).select("site")


def cell_area(lat_lo: Column, lat_hi: Column) -> Column:
    return F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo))
