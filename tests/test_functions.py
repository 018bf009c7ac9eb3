"""Special functions, kernels, grids, fills and scores against fixed values and plain versions."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.functions import kernels as K
from foretide.functions import special as S
from foretide.operators import panel, regrid
from foretide.plans import verify
from foretide.product_queries import HAVERSINE
from foretide.sources import grids


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_fixed_values(spark):
    x = [-1.2, 0.0, 0.4, 1.0, 2.0, 3.0]
    got = values(spark, [(v, 10.0) for v in x], "x double, nu double", S.t_crps(F.col("x"), F.col("nu")))
    np.testing.assert_allclose([g[0] for g in got], [0.7426977, 0.2447397, 0.3061025, 0.6022684, 1.4235096, 2.3881591], atol=1e-7)
    ((e, d),) = values(spark, [(1000.0, float("nan"))], "nu double, x double", S.t_entropy(F.col("nu")), S.t_logpdf(F.col("x"), F.lit(4.0)))
    assert abs(e - (math.log(2 * math.pi) + 1) / 2) < 1e-6 and d is None


def test_distribution_functions(spark):
    nus, xs = [1.0, 2.5, 5.0, 30.0, 300.0], [-30.0, -2.0, -0.1, 0.0, 0.7, 4.0]
    got = values(spark, [(x, n) for n in nus for x in xs], "x double, nu double", "x", "nu", S.t_cdf(F.col("x"), F.col("nu")), S.t_logpdf(F.col("x"), F.col("nu")))
    for x, nu, cdf, logpdf in got:
        u = np.linspace(-1, 1, 2_000_001) * math.atan(abs(x) / math.sqrt(nu))
        area = np.trapezoid(np.cos(u) ** (nu - 1), u) / 2 / math.exp(math.lgamma(nu / 2) + math.lgamma(0.5) - math.lgamma(nu / 2 + 0.5))
        assert abs(cdf - (0.5 + math.copysign(area, x))) < 1e-9
        want = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(x * x / nu)
        assert abs(logpdf - want) < 1e-10
    ((a, b, c),) = values(spark, [(0.3,)], "p double", S.norm_ppf(F.col("p")), S.norm_ppf(1 - F.col("p")), S.norm_ppf(F.col("p") / 100))
    assert abs(0.5 * math.erfc(-a / math.sqrt(2)) - 0.3) < 1e-8 and abs(a + b) < 1e-8 and abs(0.5 * math.erfc(-c / math.sqrt(2)) - 0.003) < 1e-9
    assert abs(S.t_cdf_value(S.t_ppf_value(0.9, 4.5), 4.5) - 0.9) < 1e-9


def test_smoother_limits():
    t, r = np.arange(12.0), np.random.default_rng(2)
    y = r.normal(size=12)
    np.testing.assert_allclose(K.smoother(t, t, 1 - 1e-12) @ y, y, atol=1e-5)
    line = np.polyval(np.polyfit(t, y, 1), [3.5, 14.0, -2.0])
    np.testing.assert_allclose(K.smoother(t, [3.5, 14.0, -2.0], 1e-9) @ y, line, atol=1e-4)
    np.testing.assert_allclose(K.smoother(t, [20.0], 0.1) @ (2 * t + 1), [41.0], atol=1e-8)


def test_shrunk_limits():
    r = np.random.default_rng(3)
    x, y, prior = np.column_stack([np.ones(30), r.normal(size=(30, 3))]), r.normal(size=30), np.array([0, 1.0, 2, 3])
    at = np.array([1.0, 0.5, 0, 1])
    assert K.shrunk(x, y, at, prior, 1, penalty=1e-12)[0] == pytest.approx(K.ols(x, y, at)[0], rel=1e-6)  # its scale leaves the free column out
    far = K.shrunk(x, y, at, prior, 1, penalty=1e12)
    assert abs(far[0] - ((y - x @ prior).mean() + at @ prior)) < 1e-6 and abs(far[2] - 29) < 1e-6
    assert abs(K.golden(lambda v: (v - 0.3) ** 2, -1, 2) - 0.3) < 1e-6
    best = K.nelder_mead(lambda ps: [float((p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2) for p in ps], np.zeros(2), 200, tolerance=1e-8)
    np.testing.assert_allclose(best, [1, -2], atol=1e-4)


def test_regrid_identity_mean_and_field(spark):
    lon, lat = np.arange(0, 361, 30.0), np.arange(-90, 91, 18.0)
    cells = lambda e: (e[1:] + e[:-1]) / 2
    u = np.cos(np.radians(cells(lon)))[None] * np.sin(np.radians(cells(lat)))[:, None]
    df = spark.createDataFrame([(i, j, float(u[i, j])) for i in range(10) for j in range(12)], "lat int, lon int, value double")
    a = regrid.axis_cells(spark, regrid.sine_limits(lat.tolist()))
    b = regrid.axis_cells(spark, lon.tolist())
    same = {(r["lat"], r["lon"]): r["value"] for r in regrid.regrid(df, {"lat": regrid.overlap_weights(a, a), "lon": regrid.overlap_weights(b, b)}).collect()}
    assert all(abs(same[i, j] - u[i, j]) < 1e-12 for i in range(10) for j in range(12))
    lat2, lon2 = np.arange(-90, 91, 30.0), np.arange(0, 361, 40.0)
    w = {"lat": regrid.overlap_weights(a, regrid.axis_cells(spark, regrid.sine_limits(lat2.tolist()))), "lon": regrid.overlap_weights(b, regrid.axis_cells(spark, lon2.tolist()), 360.0)}
    new = {(r["lat"], r["lon"]): r["value"] for r in regrid.regrid(df, w).collect()}
    area = lambda e: np.diff(np.sin(np.radians(e)))
    old_mean = (u.mean(1) * area(lat)).sum()
    new_mean = (np.array([[new[i, j] for j in range(9)] for i in range(6)]).mean(1) * area(lat2)).sum()
    assert abs(old_mean - new_mean) < 1e-12
    hole = df.withColumn("value", F.when((F.col("lat") != 0) | (F.col("lon") != 0), F.col("value")))
    assert [r["value"] for r in regrid.regrid(hole, w).where("lat = 0 AND lon = 0").collect()] == [None]
    assert regrid.regrid(hole, w, least_valid=0.2).where("lat = 0 AND lon = 0").first()["value"] is not None
    band = {k: regrid.overlap_weights(b, regrid.axis_cells(spark, np.linspace(0, 360, n).tolist())) for k, n in ((0, 4), (1, 7), (2, 7), (3, 7), (4, 7), (5, 4))}
    ea = regrid.to_equal_area(df, w["lat"], regrid.bands_weights(band))
    assert ea.count() == 2 * 3 + 4 * 6
    back = {k: regrid.overlap_weights(regrid.axis_cells(spark, np.linspace(0, 360, n).tolist()), b) for k, n in ((0, 4), (1, 7), (2, 7), (3, 7), (4, 7), (5, 4))}
    lat_back = regrid.overlap_weights(regrid.axis_cells(spark, regrid.sine_limits(lat2.tolist())), a)
    assert regrid.from_equal_area(ea, lat_back, regrid.bands_weights(back)).count() == 120


def test_nearest_and_distance(spark):
    grid = spark.createDataFrame([(i, float(la), float(lo)) for i, (la, lo) in enumerate((a, b) for a in range(-10, 11, 2) for b in range(0, 360, 20))], "site long, lat double, lon double")
    points = spark.createDataFrame([(1, 0.4, 359.0), (2, -9.0, 101.0), (3, 70.0, 0.0)], "id int, lat double, lon double")
    got = {r["id"]: r["site"] for r in regrid.nearest_cell(points, grid).collect()}
    place = {r["site"]: (r["lat"], r["lon"]) for r in grid.collect()}
    assert place[got[1]] == (0.0, 0.0) and place[got[2]][1] == 100.0
    flat = grid.select("site", F.lit(3.0).alias("value"))
    assert {r["id"]: r["value"] for r in regrid.distance_weighted(points, grid, flat).collect()} == {1: pytest.approx(3.0), 2: pytest.approx(3.0)}


@pytest.mark.parametrize("columns", [("value",), ("mu", "sigma")])
def test_distances_on_the_limits_count_as_in_sql(spark, columns):
    """Places whole degrees apart on a meridian: exactly 8 degrees (the radius) and exactly 3 (the nearest allowed) at every latitude."""
    # sites 11 degrees apart: a point 3 degrees from one is 8 degrees from the other
    places = [(float(lat), 30.0 * k) for k in range(11) for lat in range(k - 88, 89, 11)]
    grid = spark.createDataFrame([(n, a, b, 1.0 + n * n % 97) for n, (a, b) in enumerate(places)], "site long, lat double, lon double, value double")
    points = spark.createDataFrame([(lat * 100 + k, float(lat), 30.0 * k) for lat in range(-80, 81) for k in range(11)], "id int, lat double, lon double")
    values = grid.select("site", *(F.col("value").alias(c) for c in columns))
    got = regrid.distance_weighted(points, grid, values, scale=2.0, nearest=3.0, columns=columns)
    con = duckdb.connect()
    for name, df in (("p", points), ("g", grid.withColumnsRenamed({"lat": "glat", "lon": "glon"}))):
        con.register(f"{name}_", df.toArrow())
    want = con.execute(f"WITH d AS (SELECT id, value, {HAVERSINE} AS d FROM p_, g_) SELECT id, round(sum(exp(-d / 2) * value) / sum(exp(-d / 2)), 4) FROM d WHERE d < 8 GROUP BY id HAVING min(d) <= 3").fetchall()
    assert sorted((r["id"], *(round(r[c], 4) for c in columns)) for r in got.collect()) == sorted((i, *[v] * len(columns)) for i, v in want)


def test_fills(spark):
    df = spark.createDataFrame([(0, j, None if j in (0, 3, 4) else float(j)) for j in range(6)] + [(1, j, None) for j in range(6)] + [(2, j, 7.0) for j in range(6)], "lat int, lon int, value double")
    got = {(r["lat"], r["lon"]): r["filled"] for r in panel.fill_from_neighbours(df, ["lat"], "lon", 6).collect()}
    assert [got[0, j] for j in range(6)] == [5.0, 1.0, 2.0, 2.0, 5.0, 5.0] and got[1, 0] is None
    mean = {(r["lat"], r["lon"]): r["filled"] for r in panel.fill_row_mean(df, "lat").collect()}
    assert mean[0, 0] == pytest.approx(8 / 3) and mean[1, 2] == pytest.approx(8 / 3) and mean[2, 2] == 7.0
    assert panel.usable_models(spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 2.0)], "model string, site int, value double")).count() == 1


def test_normal_scores_round_trip(spark):
    r = np.random.default_rng(5)
    rows = [(s, t, float(v)) for s in range(3) for t, v in enumerate(r.normal(size=20))] + [(3, t, 4.0) for t in range(5)]
    base = spark.createDataFrame(rows, "site int, t int, value double")
    scores = {(x["site"], x["t"]): x["score"] for x in panel.normal_scores(base, ["site"]).collect()}
    back = {(x["site"], x["t"]): x["score"] for x in panel.transform_scores(base, base, ["site"], cap=False).collect()}
    assert all(abs(scores[k] - back[k]) < 1e-9 for k in scores if k[0] < 3) and all(back[3, t] == 0.0 for t in range(5))
    far = panel.transform_scores(spark.createDataFrame([(0, 99, 1e6), (0, 98, -1e6)], "site int, t int, value double"), base, ["site"]).collect()
    assert sorted(round(x["score"], 6) for x in far) == pytest.approx([-1.711675, 1.711675], abs=2e-2)


def test_scores(spark):
    r = np.random.default_rng(6)
    mu, y = r.normal(size=400), r.normal(size=400)
    pred = spark.createDataFrame([(i % 10, i // 10, float(m), 1.4, 8.0) for i, m in enumerate(mu)], "site long, t int, mu double, sigma double, nu double")
    obs = spark.createDataFrame([(i % 10, i // 10, float(v)) for i, v in enumerate(y)], "site long, t int, value double")
    s = verify.scored(pred, obs, ["site", "t"]).cache()
    got = verify.summary(s, []).first()
    assert got["rmse"] == pytest.approx(math.sqrt(((mu - y) ** 2).mean())) and got["bias"] == pytest.approx((mu - y).mean())
    assert sum(x["n"] for x in verify.pit_histogram(s, [], 10).collect()) == 400
    pit = np.sort([x["pit"] for x in s.collect()])
    i = np.arange(1, 401)
    k = verify.ks_statistic(s, [], 7).first()
    assert k["ks"] == pytest.approx(max((i / 400 - pit).max(), (pit - (i - 1) / 400).max())) and 0 <= k["kp"] <= 1
    clim = obs.groupBy("site").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    freq = [x["freq"] for x in verify.forecast_frequencies(pred, clim, [], 20).orderBy("category").collect()]
    assert len(freq) == 20 and sum(freq) == pytest.approx(1.0) and min(freq) > 0
    placed = verify.climatology_category(obs, clim, 20)
    assert placed.where("value > high OR value < low").count() == 0
    assert sum(x["freq"] for x in verify.observed_frequencies(placed, 20).collect()) == pytest.approx(1.0)


def test_terciles(spark):
    got = values(spark, [(0.95, 0.0), (0.45, 0.2), (0.1, 0.65), (0.4, 0.4), (0.3, 0.3), (0.41, 0.42)], "b double, a double", verify.tercile_class(F.col("b"), F.col("a")))
    assert [g[0] for g in got] == [-6, -1, 3, 0, 0, 1]


def test_calibration_finds_a_known_factor(spark):
    r = np.random.default_rng(7)
    z = r.standard_t(6, size=4000) * 1.5
    s = spark.createDataFrame([(float(v), 6.0) for v in z], "z double, nu double")
    a, b = verify.calibrate(s, 40)
    assert abs(a - math.log(1.5)) < 0.12 and abs(b) < 0.6


def test_flat_grid_and_months(spark, tmp_path):
    grid = np.arange(24, dtype=">f4").reshape(2, 12)
    grid[1, 3] = -999
    body = b"".join(struct.pack(">i", 48) + g.tobytes() + struct.pack(">i", 48) for g in grid)
    (tmp_path / "x.bin").write_bytes(body)
    rows = grids.read_flat_grid(spark, str(tmp_path / "x.bin"), 4, 3, 1990).orderBy("month", "lat", "lon").collect()
    assert len(rows) == 24 and rows[15]["value"] is None and rows[23]["value"] == 23.0 and (rows[12]["year"], rows[12]["month"]) == (1990, 2)
    assert (rows[5]["lat"], rows[5]["lon"]) == (1, 1)
    p = str(tmp_path / "panel")
    grids.write_panel(spark.createDataFrame([(1, 2000 + i, m, 1.0) for i in range(3) for m in (1, 2)], "site long, year int, month int, value double"), p)
    d = grids.read_panel(spark, p, (2001, 2002), 2)
    assert d.count() == 2 and "PartitionFilters: [isnotnull(month" in d._jdf.queryExecution().executedPlan().toString()
    ((y, m, d),) = values(spark, [(2000, 2)], "y int, m int", *panel.shift_month(F.col("y"), F.col("m"), -26), panel.days_per_month(F.col("y"), F.col("m")))
    assert (y, m, d) == (1997, 12, 29)
    assert panel.expand_months(spark, [1, 2], [3, 4], "zip").count() == 2


def test_hyperslabs(spark, tmp_path):
    from foretide.sources import hyperslab

    n = 30
    grid = np.arange(12 * n, dtype=">f4").reshape(n, 12)
    grid[14, 5], grid[14, 6] = -999, np.nan
    body = b"".join(struct.pack(">i", 48) + g.tobytes() + struct.pack(">i", 48) for g in grid)
    path = tmp_path / "x.bin"
    path.write_bytes(body)
    d = hyperslab.read_hyperslab(spark, str(path), 4, 3, 1990)
    whole = {tuple(r) for r in d.collect()}
    assert len(whole) == 12 * n and whole == {tuple(r) for r in grids.read_flat_grid(spark, str(path), 4, 3, 1990).collect()}
    slabs = {"year = 1991 AND month = 3 AND lat = 1": ((1991, 1991), [3], (1, 1)), "month IN (1, 12) AND lat >= 1": (None, [1, 12], (1, 9)), "year > 1991": ((1992, 2100), None, None), "year = 2050": ((2050, 2050), None, None), "lat = 7": (None, None, (7, 7)), "lat < 2": (None, None, (-3, 1)), "month = 0": (None, [], None)}
    made = {c: hyperslab.read_hyperslab(spark, str(path), 4, 3, 1990, -999.0, *slab) for c, slab in slabs.items()}
    every = spark.createDataFrame(list(whole), hyperslab.SCHEMA)
    for condition, slab in made.items():
        assert {tuple(r) for r in slab.collect()} == {tuple(r) for r in every.where(condition).collect()}, condition
    # slabs of one file in one plan, filters above, and the whole after them
    both = made["year > 1991"].where("lat = 1").union(made["lat < 2"].where("month = 2"))
    assert both.count() == every.where("year > 1991 AND lat = 1").count() + every.where("lat < 2 AND month = 2").count() and d.count() == 12 * n
    # only the records asked for become partitions
    reader = hyperslab.HyperslabReader({"path": str(path), "n_lon": "4", "n_lat": "3", "start_year": "1990", "years": "1991,1991", "months": "2,3", "lats": "1,2"})
    (slab,) = reader.partitions()
    assert slab.records.tolist() == [13, 14] and (slab.low, slab.high) == (1, 2)
    # a written folder reads back; a repeated write changes nothing
    rows = spark.createDataFrame([r for r in whole if r[4] is not None], hyperslab.SCHEMA)
    for _ in range(2):
        hyperslab.write_hyperslabs(rows, f"file:{tmp_path}/years", 4, 3)
    back = {tuple(r) for r in hyperslab.read_hyperslab(spark, f"file:{tmp_path}/years", 4, 3).where("value IS NOT NULL").collect()}
    assert back == {r for r in whole if r[4] is not None}
    (tmp_path / "bad.bin").write_bytes(body[:-1])
    with pytest.raises(Exception, match="whole number of records"):
        hyperslab.read_hyperslab(spark, str(tmp_path / "bad.bin"), 4, 3, 1990).collect()
