"""Gap filling, seasons, quantiles of large keys, inverse transforms, points and conditional skill against plain versions."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.operators import panel, regrid
from foretide.plans import assemble, predict, study, verify
from foretide.product_queries import HAVERSINE
from foretide.sources import readers, star

FCST = "site long, t int, model string, value double"


def test_fill_takes_the_models_of_the_gap_year(spark):
    """Offsets are taken from the models present in the gap year, not from all."""
    rows = [(1, t, m, v) for t in (1, 2) for m, v in (("A", 0.0), ("B", 0.0), ("C", 3.0))] + [(1, 3, "A", 0.0), (1, 3, "B", 0.0)]
    got = {(r["t"], r["model"]): (r["value"], r["filled"]) for r in panel.fill_missing_years(spark.createDataFrame(rows, FCST)).collect()}
    assert got[3, "C"] == (3.0, True) and got[1, "C"] == (3.0, False) and len(got) == 9


def test_fill_of_many_gaps(spark):
    r = np.random.default_rng(1)
    models, years = ["a", "b", "c", "d"], list(range(1, 12))
    data = {(s, t, m): (float(r.normal()), float(r.uniform(1, 2))) for s in (1, 2, 3) for t in years for m in models if r.uniform() < 0.8 or t < 4}
    for m in models[1:]:
        data.pop((3, 1, m), None), data.pop((3, 2, m), None), data.pop((3, 3, m), None)
    rows = [(*k, *v) for k, v in data.items()]
    got = panel.fill_missing_years(spark.createDataFrame(rows, f"{FCST}, sd double"), years).collect()
    assert len(got) == 3 * len(years) * len(models)
    for g in got:
        s, t, m = g["site"], g["t"], g["model"]
        own = {k[1]: v for k, v in data.items() if k[0] == s and k[2] == m}
        if not g["filled"]:
            assert (g["value"], g["sd"]) == data[s, t, m]
            continue
        beside = [n for n in models if (s, t, n) in data]
        whole = [y for y in years if all((s, y, n) in data for n in models)]
        want = np.mean([data[s, t, n][0] for n in beside]) + np.mean([data[s, y, m][0] - np.mean([data[s, y, n][0] for n in beside]) for y in whole]) if beside and whole else None
        assert (g["value"] is None) == (want is None) and (want is None or abs(g["value"] - want) < 1e-12)
        assert abs(g["sd"] - math.sqrt(np.mean([v[1] ** 2 for v in own.values()]))) < 1e-12


def test_a_year_without_models_is_an_error(spark):
    d = spark.createDataFrame([(1, 1, "A", 0.0), (2, 3, "A", 1.0)], FCST)
    assert panel.fill_missing_years(d, [1, 3]).where("value IS NULL").count() == 2
    with pytest.raises(Exception, match="no forecasts in year 2"):
        panel.fill_missing_years(d, [1, 2, 3]).collect()
    assert panel.fill_missing_years(d.limit(0)).count() == 0


def test_assembled_forecasts(spark):
    r = np.random.default_rng(2)
    rows = [(s, y, 5, m, float(r.normal()), 1.0) for s in range(4) for y in range(2000, 2010) for m in "abc" if not (m == "b" and y == 2004) and not (m == "c" and s == 3)]
    d = assemble.assemble_forecasts(spark.createDataFrame(rows, "site long, year int, month int, model string, vals_mean double, vals_sd double"), 5, 2000, 2009)
    got = d.toPandas()
    assert set(got["model"]) == {"a", "b"} and len(got) == 80 and got["filled"].sum() == 4 and got["trend"].notna().all()
    one = got[(got["site"] == 2) & (got["model"] == "b")].sort_values("t")
    from foretide.functions.kernels import smoother

    t = np.arange(2000.0, 2010)
    np.testing.assert_allclose(one["trend"], smoother(t, t, 3e-4) @ one["value"].to_numpy(), atol=1e-8)


def test_seasons_meet_over_the_end_of_a_year(spark):
    """Each month counts back from its own target; months of longer panels lose their oldest years; a rank with a gap goes."""
    rows = [(s, y, m, float(100 * y + m + s), float(y)) for s in (0, 1) for m, first in ((12, 2000), (1, 1998), (2, 2000)) for y in range(first, 2007) if not (s == 1 and m == 1 and y == 2004)]
    d = panel.right_aligned(spark.createDataFrame(rows, "site long, year int, month int, value double, trend double"), [(2006, 12), (2007, 1), (2007, 2)], 6, ["value", "trend"], ["site"])
    got = {(r["site"], r["year"]): (r["value"], r["trend"]) for r in d.collect()}
    w = {12: 31 / 90, 1: 31 / 90, 2: 28 / 90}
    assert sorted(y for s, y in got if s == 0) == list(range(2000, 2006)) and sorted(y for s, y in got if s == 1) == [2000, 2001, 2002, 2004, 2005]
    for (s, y), (value, trend) in got.items():
        years = {12: y, 1: y + 1, 2: y + 1}
        assert abs(value - sum(w[m] * (100 * years[m] + m + s) for m in w)) < 1e-9 and abs(trend - sum(w[m] * years[m] for m in w)) < 1e-9


@pytest.mark.parametrize("hazen", [True, False])
def test_exact_quantiles(spark, monkeypatch, hazen):
    """Ties, outliers by many powers of ten, nulls, one value, and a key that holds most rows."""
    monkeypatch.setattr(panel, "BINS", 8)
    monkeypatch.setattr(panel, "FEW", 5)
    r = np.random.default_rng(3)
    hot = np.concatenate([r.normal(size=3000), np.repeat([0.25, -1.0], 400), 10.0 ** r.integers(-300, 300, size=200)])
    rows = [("hot", float(v)) for v in hot] + [("one", 4.0), ("two", -1e308), ("two", 1e308), ("none", None)] + [(None, float(v)) for v in r.integers(0, 3, size=50)]
    df = spark.createDataFrame([x for x in rows if x[0] is not None], "k string, value double")
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    got = {x["k"]: x["quantiles"] for x in panel.exact_quantiles(df, ["k"], qs, hazen).collect()}
    want = {x["k"]: x["quantiles"] for x in panel.quantiles(df, ["k"], qs, hazen).collect()}
    assert got.keys() == {"hot", "one", "two"} == want.keys()
    for k in ("hot", "one"):
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)
    (whole,) = panel.exact_quantiles(df.select("value"), [], [0.5], hazen).collect()
    assert whole["quantiles"] == pytest.approx(panel.quantiles(df.withColumn("k", F.lit(1)), ["k"], [0.5], hazen).first()["quantiles"])
    assert panel.exact_quantiles(df.limit(0), ["k"], qs).count() == 0
    monkeypatch.setattr(panel, "MOST_KEYS", 2)
    with pytest.raises(ValueError):
        panel.exact_quantiles(df, ["k"], qs)


def test_inverse_of_normal_scores(spark):
    r = np.random.default_rng(5)
    values = r.gamma(2.0, size=(3, 21))
    base = spark.createDataFrame([(s, t, float(values[s, t])) for s in range(3) for t in range(21)] + [(3, 0, 7.0)], "site long, t int, value double")
    scores = panel.normal_scores(base, ["site"]).select("site", "t", F.col("value").alias("own"), (F.col("avg_rank") / F.when(F.col("site") < 3, 22.0).otherwise(2.0)).alias("quantile"))
    for g in panel.values_at(base, scores, ["site"]).collect():
        assert abs(g["value"] - g["own"]) < 1e-9
    z = lambda p: float(spark.range(1).select(predict_ppf(p)).first()[0])
    from foretide.functions.special import norm_ppf

    def predict_ppf(p):
        return norm_ppf(F.lit(float(p)))

    far = {(g["site"], g["quantile"]): g["value"] for g in panel.values_at(base, spark.createDataFrame([(0, 0.999), (0, 0.001), (0, 1.0), (3, 0.2)], "site long, quantile double"), ["site"]).collect()}
    s = np.sort(values[0])
    slope = (s[-1] - s[-2]) / (z(21 / 22) - z(20 / 22))
    assert far[0, 0.999] == pytest.approx(s[-2] + (z(0.999) - z(20 / 22)) * slope) and far[0, 0.001] < s[0]
    assert far[0, 1.0] is None and far[3, 0.2] == 7.0


def test_points_go_to_the_nearest_cell(spark):
    lats, lons = [10.0, 4.0, 3.0, -6.0], [0.0, 10.0, 40.0, 350.0]
    cases = [(-20.0, 3), (3.4, 2), (3.5, 2), (3.6, 1), (7.1, 0), (99.0, 0), (-1.4, 2), (-1.6, 3)]
    got = spark.createDataFrame([(x,) for x, _ in cases], "x double").select(regrid.nearest_on_axis(F.col("x"), lats)).collect()
    assert [g[0] for g in got] == [i for _, i in cases]
    rows = [(2000, 1, 5, 9.0, -11.0, 1.0), (2000, 1, 7, 9.5, 351.0, 2.0), (2000, 1, 6, 9.9, 355.0, 3.0), (1700, 1, 1, 9.0, 0.0, 4.0), (2000, 2, 9, 3.0, 12.0, float("nan")), (2000, 2, 8, 3.0, 12.0, 5.0)]
    df = spark.createDataFrame(rows, "year int, month int, ordinal int, lat double, lon double, value double")
    assert sorted(tuple(r) for r in readers.read_points(df, "bestland", lats, lons).collect()) == [(2000, 1, 0, 3, 2.0), (2000, 2, 2, 1, None)]
    with pytest.raises(ValueError):
        readers.read_observations(df, "bestland", {})


def test_conditional_skill(spark):
    r = np.random.default_rng(6)
    rows = [(s, t, float(r.normal()), 0.05 if s == 1 else 1.0, 9.0) for s in range(6) for t in range(30)]
    pred = spark.createDataFrame(rows, "site long, t int, mu double, sigma double, nu double")
    seen = spark.createDataFrame([(s, t, int(r.integers(1, 6))) for s in range(6) for t in range(30)], "site long, t int, category int")
    clim = spark.createDataFrame([(s, 0.1 * s, 1.0) for s in range(6)], "site long, mean double, sd double")
    classes = study.climate_classes(clim.select("site", "mean"), 2)
    got = {(g["class"], g["category"]): g for g in study.conditional_skill(pred, seen, clim, classes, ["site", "t"], 5).collect()}
    assert {c["class"]: c["n"] for c in classes.groupBy("class").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 3}
    assert len(got) == 10 and all(g["n_rows"] == 90 for g in got.values()) and sum(g["n_seen"] for g in got.values()) == 180
    from foretide.functions.special import t_cdf_value

    edges = [-math.inf, *verify.category_bounds(5), math.inf]
    cdf = lambda x, mu, sg: 0.0 if x == -math.inf else 1.0 if x == math.inf else t_cdf_value((x - mu) / sg, 9.0)
    sees = {(s["site"], s["t"]): s["category"] for s in seen.collect()}
    each = [(sees[s, t], math.log(max(math.exp(-40), cdf(0.1 * s + edges[2], mu, sg) - cdf(0.1 * s + edges[1], mu, sg)))) for s, t, mu, sg, _ in rows if s < 3]
    assert got[1, 2]["mean_log"] == pytest.approx(np.mean([p for _, p in each]), abs=1e-6)
    assert got[1, 2]["mean_log_seen"] == pytest.approx(np.mean([p for c, p in each if c == 2]), abs=1e-5) and min(g["mean_log"] for g in got.values()) >= -40


def test_climatology_quantiles_with_factors(spark):
    pred = spark.createDataFrame([(1, 0.0, 1.0, 8.0)], "site long, mu double, sigma double, nu double")
    clim = spark.createDataFrame([(1, float(v)) for v in range(-5, 6)], "site long, value double")
    plain, wide = (verify.quantiles_cdf(pred, clim, [0.5, 0.9], f).orderBy("q").collect() for f in (None, (math.log(2), math.log(2))))
    assert plain[0]["p"] == pytest.approx(0.5) and plain[1]["value"] == pytest.approx(4.4)
    from foretide.functions.special import t_cdf_value

    assert plain[1]["p"] == pytest.approx(t_cdf_value(4.4, 8.0)) and wide[1]["p"] == pytest.approx(t_cdf_value(2.2, 16.0))


def test_repeated_forecasts_are_averaged(spark):
    """A model with two values for a time counts with their mean, whatever the order of rows."""
    r = np.random.default_rng(9)
    obs = spark.createDataFrame([(s, t, float(r.normal())) for s in range(3) for t in range(12)], "site long, t int, value double")
    rows = [(s, t, "m", float(r.normal())) for s in range(3) for t in range(13)]
    twice = [(s, t, m, v + d) for s, t, m, v in rows for d in (-1.0, 1.0)]
    a, b = (P.predict("rawmodel_scaled", obs, spark.createDataFrame(x, FCST), P.Options(t_pred=12)).orderBy("site").collect() for P, x in ((predict, rows), (predict, twice)))
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9)


def test_target_of_a_date(spark):
    days = ["2015-01-08", "2015-01-09", "2015-10-31", "2015-11-08", "2015-12-20"]
    d = spark.createDataFrame([(x,) for x in days], "d string").select(*panel.target_of(F.to_date("d"), 2))
    assert [tuple(r) for r in d.collect()] == [(2015, 3, 3), (2015, 3, 2), (2015, 12, 2), (2016, 1, 3), (2016, 2, 2)]


def test_detrended_correlation(spark):
    """The partial correlation equals the correlation of what is left of both series by their lines, after permutation too."""
    r = np.random.default_rng(4)
    y, x = r.normal(size=(3, 12)) + 0.4 * np.arange(12), r.normal(size=(3, 12)) + 0.2 * np.arange(12)
    obs = spark.createDataFrame([(s, t, float(y[s, t])) for s in range(3) for t in range(12)], "site long, t int, value double")
    fcst = spark.createDataFrame([(s, t, lag, float(x[s, t] * lag)) for s in range(3) for t in range(12) for lag in (1, 2)], "site long, t int, lag int, value double")
    weights = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (1, "b", 1.0), (2, "b", 0.0)], "site long, subset string, w double")
    got = {(g["lag"], g["subset"], g["seed"]): g for g in study.correlation_study(obs, fcst, 1, weights, [5]).collect()}
    order = {p["t"]: p["other"] for p in study.permutation(obs.select("t").distinct(), 1, [5]).collect()}
    rest = lambda v: v - np.polyval(np.polyfit(np.arange(12), v, 1), np.arange(12))
    assert len(got) == 8
    for seed, places in ((0, np.arange(12)), (5, np.asarray([order[t] for t in range(12)]))):
        raw = [np.corrcoef(y[s], x[s][places])[0, 1] for s in range(3)]
        left = [np.corrcoef(rest(y[s]), rest(x[s][places]))[0, 1] for s in range(3)]
        for lag in (1, 2):
            g = got[lag, "a", seed]
            assert g["r"] == pytest.approx((raw[0] + 3 * raw[1]) / 4) and g["r_detrended"] == pytest.approx((left[0] + 3 * left[1]) / 4)
            assert got[lag, "b", seed]["r_detrended"] == pytest.approx(left[1])


@pytest.mark.parametrize("dataset", ["ncep", "best", "gpcp", "hadsst", "cams"])
def test_data_sets(spark, dataset):
    """Start, missing numbers, gaps and new cells of each gridded data set, against plain loops."""
    r = np.random.default_rng(7)
    start, n_lat, n_lon = readers.DATA_SETS[dataset].start, 6, 4
    u = r.uniform(1, 9, size=(n_lat, n_lon))
    bad = (r.uniform(size=u.shape) < 0.3) & (dataset != "ncep")
    bad[2] = dataset != "ncep"  # a whole row
    mark = {"gpcp": -5.0, "cams": -999.0}.get(dataset, float("nan"))
    rows = [(y, 1, i, j, mark if bad[i, j] else float(u[i, j])) for y in (start - 1, start) for i in range(n_lat) for j in range(n_lon)]
    cells = lambda n, step: regrid.axis_cells(spark, [float(step * i) for i in range(n + 1)])
    axes = {"lat": regrid.overlap_weights(cells(n_lat, 1), cells(2, 3)), "lon": regrid.overlap_weights(cells(n_lon, 1), cells(2, 2))}
    got = {(g["lat"], g["lon"]): g["value"] for g in readers.read_observations(spark.createDataFrame(rows, "year int, month int, lat int, lon int, value double"), dataset, axes, n_lon).collect()}
    v = np.where(bad, np.nan, u)
    if dataset == "cams":
        for axis, turn in ((1, n_lon), (0, 0)):
            w = v.copy()
            for i, j in np.argwhere(np.isnan(v)):
                line, at = (v[i], j) if axis else (v[:, j], i)
                near = [(abs(p + c * turn - at), p + c * turn, line[p]) for p in range(len(line)) for c in ((-1, 0, 1) if turn else (0,)) if not np.isnan(line[p])]
                w[i, j] = min(near)[2] if near else np.nan
            v = w
    elif dataset != "ncep":
        means = np.array([np.nanmean(x) if not np.isnan(x).all() else np.nan for x in v])
        known = [i for i in range(n_lat) if not np.isnan(means[i])]
        means = [means[min(known, key=lambda k: (abs(k - i), k))] for i in range(n_lat)]
        v = np.where(np.isnan(v), np.array(means)[:, None], v)
    assert len(got) == 4
    for (a, b), value in got.items():
        block = np.ix_(range(3 * a, 3 * a + 3), range(2 * b, 2 * b + 2))
        if dataset == "cams" and (~bad[block]).mean() < 0.5:
            assert value is None
        else:
            assert value == pytest.approx(v[block].mean())


def test_regions(spark):
    places = [(1, 10.0, 350.0, 0.9), (2, 10.0, -5.0, 0.2), (3, 10.0, 20.0, 0.9), (4, 60.0, 0.0, 0.9), (5, -10.0, 0.0, 0.51), (6, 0.0, 180.0, 1.0)]
    cells = spark.createDataFrame(places, "site int, lat double, lon double, share double")
    sites = lambda *a: sorted(r[0] for r in regrid.region(cells, *a).collect())
    assert sites((-10.0, 30.0, -20.0, 10.0)) == [1, 2, 5] and sites((-10.0, 30.0, -20.0, 10.0), 0.51) == [1, 5]
    assert sites((-90.0, 90.0, 0.0, 360.0)) == [1, 2, 3, 4, 5, 6] and sites((-90.0, 90.0, 170.0, 190.0)) == [6]


@pytest.mark.parametrize("panel_of, sites", [("supplier_fcst", "supplier"), ("part_fcst", "part")])
def test_no_task_makes_the_forecasts_of_all_sites(spark, monkeypatch, panel_of, sites):
    """Sites come from a small file; the rows of their groups must not all be made by the task that reads it."""
    monkeypatch.setattr(star, "FANNED_ROWS", 2000, raising=False)
    made = getattr(star, panel_of)(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) > 3 * 2000 and max(sizes) < 0.5 * sum(sizes)
    assert made.groupBy("site", "t", "model").count().where("count > 1").isEmpty()
    assert made.select("site").distinct().count() == star.table(spark, "/root/testdata/sf0.01", sites).count()


@pytest.mark.parametrize("dense", [False, True])
def test_nearest_cells_of_a_dense_grid(spark, monkeypatch, dense):
    """A point meets a bounded number of cells, whatever the reach asked for; sites of one place, far points and ties as in SQL."""
    r = np.random.default_rng(8)
    at = [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(r.uniform(-1, 0.8, 6000))), r.uniform(0, 360, 6000))]
    if dense:  # most cells in one small place, a few of the others
        at = [(10 + a / 50, 20 + b / 300) for a, b in at] + at[:100]
    at += at[:300] + [(-89.0, 0.0), (-89.0, 180.0)]
    grid = spark.createDataFrame([(i * 37 % 9973, a, b) for i, (a, b) in enumerate(at)], "site long, lat double, lon double")
    some = [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(r.uniform(-1, 1, 300))), r.uniform(0, 360, 300))] + [(-90.0, 5.0), (0.0, 0.0)]
    some += [(10.1 + k / 100, 20.3 + k / 90) for k in range(60)]
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(some)], "id int, lat double, lon double")
    pairs, near = [], regrid._near
    monkeypatch.setattr(regrid, "_near", lambda *a: pairs.append(near(*a).count()) or near(*a))
    got = regrid.nearest_cell(points, grid, 10.0)
    con = duckdb.connect()
    for name, df in (("p", points), ("g", grid.withColumnsRenamed({"lat": "glat", "lon": "glon"}))):
        con.register(f"{name}_", df.toArrow())
    want = con.execute(f"WITH d AS (SELECT id, site, {HAVERSINE} AS d FROM p_, g_) SELECT id, site, round(d, 6) FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, site) = 1").fetchall()
    assert sorted((x["id"], x["site"], round(x["distance"], 6)) for x in got.collect()) == sorted(want)
    if not dense:
        assert sum(pairs) < 30 * len(some)


def test_near_cells_are_not_broadcast(spark):
    key = F.col("s_suppkey")
    grid = star.table(spark, "/root/testdata/sf0.01", "supplier").select(key.alias("site"), (key % 90).cast("double").alias("lat"), key.cast("double").alias("lon"))
    points = grid.withColumnRenamed("site", "id")
    assert "Broadcast" not in regrid._near(points, grid, 5.0)._jdf.queryExecution().executedPlan().toString()


def _exchanged(spark, df):
    """The rows of df, and how many rows Spark wrote for exchanges on the way."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    rows = df.collect()
    return rows, sum(n for i, n in stages().items() if i not in before)


@pytest.mark.parametrize("shared", [1, 30])
def test_pairs_of_points_and_sites_are_not_written(spark, request, shared):
    """Pairs grow with points times sites: exchanged are points, cells and sites, however many sites share a place; means as in SQL."""
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")  # as at a size where the values are no small table
    request.addfinalizer(lambda: spark.conf.set(small, before))
    r = np.random.default_rng(12)
    at = [(float(a), float(b)) for a in range(-90, 91, 2) for b in range(0, 40, 2)] if shared == 1 else [(float(a), float(b)) for a in range(-89, 90, 8) for b in range(0, 40, 8)]
    sites = [(i, *at[i % len(at)], None if i % 11 == 3 else float(r.normal(100, 9)), float(i % 7)) for i in range(shared * len(at))]
    grid = spark.createDataFrame(sites, "site long, lat double, lon double, mu double, nu double")
    some = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-90, 90, 3000), r.uniform(0, 40, 3000)))] + [(0, 1.0, 2.0), (9999, None, 3.0)]
    points = spark.createDataFrame(some, "id int, lat double, lon double")
    got, written = _exchanged(spark, regrid.distance_weighted(points, grid.select("site", "lat", "lon"), grid.select("site", "mu", "nu"), scale=2.0, nearest=3.0, columns=("mu", "nu")))
    con = duckdb.connect()
    for name, df in (("p", points), ("g", grid.withColumnsRenamed({"lat": "glat", "lon": "glon"}))):
        con.register(f"{name}_", df.toArrow())
    con.execute(f"CREATE TABLE d AS SELECT id, mu, nu, {HAVERSINE} AS d FROM p_, g_ WHERE mu IS NOT NULL AND nu IS NOT NULL")
    want = con.execute("SELECT id, sum(exp(-d / 2) * mu) / sum(exp(-d / 2)), sum(exp(-d / 2) * nu) / sum(exp(-d / 2)) FROM d WHERE d < 8 GROUP BY id HAVING min(d) <= 3 ORDER BY id").fetchall()
    assert len(want) > 500 and [x for w in want for x in w] == pytest.approx([x for g in sorted((x["id"], x["mu"], x["nu"]) for x in got) for x in g], rel=1e-9)
    pairs = con.execute("SELECT count(*) FROM d WHERE d < 8").fetchone()[0]
    assert written < 2 * len(some) + 27 * len(at) + 4 * len(sites) < pairs
