"""Queries of assembled panels, searched weights, inverse transforms, large quantiles, points, seasons and conditional skill, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.method_sql import METHODS, P, SERIES, solved, spline
from foretide.operators import panel, regrid
from foretide.plans import assemble, predict, study, verify
from foretide.product_queries import CLIM, HAVERSINE, LINE, MODEL_LINE, ON_GRID, PLACES, QUANTITIES, _grid_weights, _places, sql_norm_ppf
from foretide.queries import FCST, GAPPY, HAZEN, METHOD_SQL, OBS, OBS_SUPPLIER, OPTIONS, PRED, SQL, T_PRED, ZERO, _plain, _predictions, query, rounded, sql_hazen, sql_moments, sql_t_cdf, unrounded
from foretide.sources import hyperslab, readers, star

# ---- gap filling and assembly ----


@query(f"WITH {OBS}, {GAPPY} SELECT site, t, model, round(value, 4) AS value, round(sd, 4) AS sd, filled FROM filled")
def b_fill_spread(spark, sf):
    return rounded(panel.fill_missing_years(star.fcst_gappy(spark, sf, spread=True)))


def _monthly(spark, sf) -> DataFrame:
    """site, year, month, value"""
    return star.obs_panel(spark, sf, True).select("site", (1995 + F.floor((F.col("t") - 1) / 12)).cast("int").alias("year"), ((F.col("t") - 1) % 12 + 1).cast("int").alias("month"), "value")


@query(f"""WITH RECURSIVE {OBS}, m3 AS (SELECT site, list(value ORDER BY t) AS y, list(CAST(1995 + (t - 1) // 12 AS INTEGER) ORDER BY t) AS ts FROM obsm WHERE (t - 1) % 12 = 2 AND t <= 72 GROUP BY site HAVING count(*) = 6), {spline('ot', 'm3')}
SELECT site, unnest(ts) AS t, round(unnest(y), 4) AS value, round(unnest(trend), 4) AS trend, round(ahead, 4) AS trend_pred FROM ot""")
def s_assembled_observations(spark, sf):
    return rounded(assemble.assemble_observations(_monthly(spark, sf), 3, 1995, 2000, P))


@query(f"""WITH RECURSIVE {OBS}, {GAPPY.replace('FROM o_ GROUP BY 1, 2, 3)', 'FROM o_ GROUP BY 1, 2, 3 HAVING t <= 26)')}, fs AS (SELECT site, model, list(value ORDER BY t) AS y, list(t ORDER BY t) AS ts FROM filled WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 26), {spline('ot', 'fs')},
tr AS (SELECT site, model, unnest(ts) AS t, unnest(trend) AS trend FROM ot)
SELECT site, t, model, round(value, 4) AS value, round(sd, 4) AS sd, filled, round(trend, 4) AS trend FROM filled LEFT JOIN tr USING (site, t, model)""")
def s_assembled_forecasts(spark, sf):
    d = star.fcst_gappy(spark, sf, spread=True).select("site", F.col("t").alias("year"), F.lit(1).alias("month"), "model", F.col("value").alias("vals_mean"), F.col("sd").alias("vals_sd"))
    return rounded(assemble.assemble_forecasts(d, 1, 1, T_PRED - 1, P))


# ---- the likeliest mixing weight ----


@query(f"""WITH RECURSIVE {OBS}, {SERIES}, gr AS (SELECT i / 20.0 AS gam FROM range(1, 20) r(i)), vs AS (SELECT list(v ORDER BY v DESC) AS v, count(*) AS n FROM (SELECT DISTINCT CAST(27 - t AS DOUBLE) AS v FROM h)),
q0 AS (SELECT CAST(gam AS DOUBLE) AS gam, list_transform(range(1, n + 1), lambda i: list_concat(list_transform(range(1, n + 1), lambda j: CAST(gam AS DOUBLE) * least(v[i], v[j]) + CASE WHEN i = j THEN 1 - CAST(gam AS DOUBLE) ELSE 0.0 END), list_transform(range(1, n + 1), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END))) AS a FROM vs, gr), {solved('q1', 'q0', True)},
q AS (SELECT gam, logdet, list_transform(a, lambda r: r[len(a) + 1 : 2 * len(a)]) AS q FROM q1),
c AS (SELECT site, list_avg(y) AS level, list_transform(y, lambda e: e - list_avg(y)) AS y FROM hs),
d AS (SELECT site, level, gam, logdet, len(y) AS n, y, list_transform(q, lambda r: list_dot_product(r, y)) AS qy, list_sum(list_transform(q, lambda r: list_sum(r))) AS oo FROM c, q),
e AS (SELECT *, list_sum(qy) AS oy, list_dot_product(y, qy) - pow(list_sum(qy), 2) / oo AS rss FROM d),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY site ORDER BY rss + logdet, gam) = 1)
SELECT site, round(gam, 4) AS gamma, round(level + oy / oo, 4) AS mu, round(sqrt(rss / n * (1 - gam + 1 / oo)), 4) AS sigma, CAST(n - 1 AS DOUBLE) AS nu FROM b""")
def k_adaptive_gamma(spark, sf):
    inputs = predict.Inputs(star.obs_panel(spark, sf), None, None, OPTIONS)
    return rounded(predict.adaptive_walk(inputs, grid=19, refine=False, low=0.05, high=0.95))


# ---- transforms and their inverse ----

_PIECE = "greatest(1, least(n - 1, CAST(floor(q * (n + 1)) AS INTEGER)))"


@query(f"""WITH {OBS}, s AS (SELECT site, list_sort(list(value)) AS s, count(*) AS n FROM h GROUP BY 1), q AS (SELECT *, CAST(unnest([0.01, 0.25, 0.5, 0.9, 0.99]) AS DOUBLE) AS q FROM s), k AS (SELECT *, {_PIECE} AS k FROM q),
z AS (SELECT *, {sql_norm_ppf('(k / (n + 1.0))')} AS z0, {sql_norm_ppf('((k + 1) / (n + 1.0))')} AS z1, {sql_norm_ppf('q')} AS z FROM k)
SELECT site, q AS quantile, round(s[k] + (z - z0) / (z1 - z0) * (s[k + 1] - s[k]), 4) AS value FROM z""")
def b_values_at(spark, sf):
    past = star.obs_panel(spark, sf).where(f"t < {T_PRED}")
    wanted = past.select("site").distinct().withColumn("quantile", F.explode(F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.9, 0.99)))))
    return rounded(panel.values_at(past, wanted, ["site"]))


@query(f"""WITH RECURSIVE {OBS}, {SERIES}, {spline('ot', 'hs')}, tr AS (SELECT site, unnest(list_append(trend, ahead)) AS value, unnest(range(1, 28)) AS t FROM ot),
r AS (SELECT site, value, rank() OVER (PARTITION BY site ORDER BY value) AS r, count(*) OVER (PARTITION BY site) AS n FROM h),
k AS (SELECT site, list(value ORDER BY value) AS x, list({sql_norm_ppf('(r / (n + 1.0))')} ORDER BY value) AS s, count(*) AS n FROM r GROUP BY site),
o AS (SELECT *, greatest(1, least(n - 1, len(list_filter(x, lambda e: e <= value)))) AS i FROM tr JOIN k USING (site)),
f AS (SELECT *, s[i] + (value - x[i]) * (s[i + 1] - s[i]) / (x[i + 1] - x[i]) AS score, -{sql_norm_ppf('(1 / (n + 27 + 1.0))')} AS top FROM o)
SELECT site, CAST(t AS INTEGER) AS t, round(greatest(-top, least(top, score)), 6) AS trend_score FROM f""")
def s_precipitation(spark, sf):
    obs = star.obs_panel(spark, sf).where(f"t < {T_PRED}")
    d = predict.with_trend(obs, ["site"], list(range(1, T_PRED)), T_PRED, P)
    trend = d.select("site", "t", F.col("trend").alias("value")).unionByName(d.groupBy("site").agg(F.first("trend_pred").alias("value")).withColumn("t", F.lit(T_PRED)))
    return readers.transform_precipitation(obs, trend, ["site"])[1].select("site", "t", F.round("value", 6).alias("trend_score"))


@query(f"""WITH {OBS}, p AS ({LINE}), q AS (SELECT site, unnest([0.1, 0.5, 0.9]) AS q, unnest([{', '.join(sql_hazen(q) for q in ('0.1', '0.5', '0.9'))}]) AS value FROM {HAZEN})
SELECT site, CAST(q AS DOUBLE) AS q, round(value, 4) AS value, round({sql_t_cdf('((value - mu) / sigma)', 'nu')}, 6) AS p FROM p JOIN q USING (site)""")
def v_quantiles_cdf(spark, sf):
    obs = star.obs_panel(spark, sf)
    d = verify.quantiles_cdf(predict.predict("linear", obs, None, OPTIONS), obs.where(f"t < {T_PRED}"), [0.1, 0.5, 0.9])
    return d.select("site", "q", F.round("value", 4).alias("value"), F.round("p", 6).alias("p"))


# ---- quantiles of one large key ----


@query("""WITH s AS (SELECT list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem), q AS (SELECT *, CAST(unnest([0.1, 0.5, 0.95]) AS DOUBLE) AS q FROM s), k AS (SELECT *, greatest(1.0, least(n, q * n + 0.5)) AS h FROM q)
SELECT q, round(s[CAST(floor(h) AS INTEGER)] + (h - floor(h)) * (s[CAST(least(floor(h) + 1, n) AS INTEGER)] - s[CAST(floor(h) AS INTEGER)]), 4) AS value FROM k""")
def a_exact_quantiles(spark, sf):
    d = panel.exact_quantiles(star.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")), [], [0.1, 0.5, 0.95])
    return d.select(F.explode(F.arrays_zip(F.array(*map(F.lit, (0.1, 0.5, 0.95))).alias("q"), F.col("quantiles").alias("value"))).alias("z")).select("z.q", F.round("z.value", 4).alias("value"))


# ---- points on a grid of uneven axes ----

LATS, LONS = [-90 + 7.5 * i + 0.3 * (i % 3) for i in range(25)], [15.0 * i + 0.2 * (i % 4) for i in range(24)]


def _sql_nearest(x: str, axis: list[float]) -> str:
    a = "[" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in axis) + "]"
    i = f"greatest(1, least({len(axis) - 1}, len(list_filter({a}, lambda c: c <= {x}))))"
    return f"CAST(greatest(0, least({len(axis) - 1}, floor({i} - 1 + ({x} - {a}[{i}]) / ({a}[{i} + 1] - {a}[{i}]) + 0.5))) AS INTEGER)"


@query(f"""WITH p AS (SELECT c_custkey AS ordinal, CAST(c_custkey % 3 + 1 AS INTEGER) AS month, CAST(c_custkey * 7 % 1741 AS DOUBLE) / 10 - 87 AS lat, CAST(c_custkey * 13 % 3593 AS DOUBLE) / 10 - 180 AS lon0, c_acctbal AS value FROM customer),
q AS (SELECT *, CASE WHEN lon0 < 0 THEN lon0 + 360 ELSE lon0 END AS lon FROM p), r AS (SELECT ordinal, month, {_sql_nearest('lat', LATS)} AS lat, {_sql_nearest('lon', LONS)} AS lon, value FROM q)
SELECT month, lat, lon, round(value, 4) AS value FROM r QUALIFY row_number() OVER (PARTITION BY month, lat, lon ORDER BY ordinal DESC) = 1""")
def s_bestland(spark, sf):
    key = F.col("c_custkey")
    points = star.table(spark, sf, "customer").select(key.alias("ordinal"), (key % 3 + 1).cast("int").alias("month"), ((key * 7 % 1741).cast("double") / 10 - 87).alias("lat"), ((key * 13 % 3593).cast("double") / 10 - 180).alias("lon"), F.col("c_acctbal").alias("value"))
    return rounded(readers.read_points(points, "bestland", LATS, LONS, ["month"]))


# ---- seasons over the end of a year ----


@query(f"""WITH {OBS}, m AS (SELECT site, CAST(1995 + (t - 1) // 12 AS INTEGER) AS year, (t - 1) % 12 + 1 AS month, value FROM obsm),
s AS (SELECT site, CASE WHEN month = 12 THEN year ELSE year - 1 END AS year, CASE WHEN month = 2 THEN 28 ELSE 31 END AS days, value FROM m WHERE month IN (12, 1, 2))
SELECT site, CAST(year AS INTEGER) AS year, round(sum(days * value) / 90, 4) AS value FROM s WHERE year BETWEEN 1995 AND 2000 GROUP BY 1, 2 HAVING count(*) = 3""")
def a_winter(spark, sf):
    return rounded(panel.right_aligned(_monthly(spark, sf), [(2000, 12), (2001, 1), (2001, 2)], 5, ["value"], ["site"]))


# ---- skill by climate and category ----

_CATEGORIES = 20
_EDGES = ", ".join(repr(b) for b in verify.category_bounds(_CATEGORIES))


@query(f"""WITH {PRED}, {CLIM}, e AS (SELECT list_sort(list(mean)) AS s, count(*) AS n FROM clim), cut AS (SELECT [{', '.join(sql_hazen(f'({k} / 5.0)') for k in range(1, 5))}] AS edges FROM e),
k AS (SELECT site, CAST(1 + len(list_filter(edges, lambda x: x <= mean)) AS INTEGER) AS class FROM clim, cut),
lv AS (SELECT unnest(range(1, {_CATEGORIES + 1})) AS category, [{_EDGES}] AS b),
x AS (SELECT class, CAST(category AS INTEGER) AS category, CAST(greatest(1, ceil({_CATEGORIES} * {sql_t_cdf('((y - mean) / sd)', f'{_CATEGORIES - 1}.0')})) AS INTEGER) AS seen,
  CASE WHEN category = {_CATEGORIES} THEN 1.0 ELSE {sql_t_cdf('((mean + sd * b[category] - mu) / sigma)', 'nu')} END - CASE WHEN category = 1 THEN 0.0 ELSE {sql_t_cdf('((mean + sd * b[category - 1] - mu) / sigma)', 'nu')} END AS p FROM s JOIN clim USING (site) JOIN k USING (site), lv)
SELECT class, category, count(*) AS n_rows, round(avg(ln(greatest(exp(-40), p))), 5) AS mean_log, count(*) FILTER (seen = category) AS n_seen, round(avg(ln(greatest(exp(-40), p))) FILTER (seen = category), 5) AS mean_log_seen FROM x GROUP BY 1, 2""")
def v_conditional_skill(spark, sf):
    obs = star.obs_panel(spark, sf)
    clim = obs.where("t < 20").groupBy("site").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    placed = verify.climatology_category(obs, clim, _CATEGORIES)
    d = study.conditional_skill(_predictions(spark, sf), placed, clim, study.climate_classes(clim.select("site", "mean"), 5), ["site", "t"], _CATEGORIES)
    return rounded(d, 5)


# ---- long histories, and very many sites ----

LONG_PRED = 400
LONG = """o_ AS (SELECT CAST(n_regionkey AS BIGINT) AS site, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 6) AS INTEGER) AS t, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
obs AS (SELECT site, t, avg(l_extendedprice) AS value FROM o_ GROUP BY 1, 2), h AS (SELECT * FROM obs WHERE t < 400)"""
_TIMES = "(SELECT count(DISTINCT t) FROM h)"


def sql_filter(degree: int) -> str:
    """A random walk plus noise, filtered step by step from the target back, a row a step."""
    g = repr(OPTIONS.gamma)
    names = ["y", "o"] + ["v"] * degree
    value = {"y": "x.y", "o": "1.0", "v": "x.v"}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    step = ", ".join([f"f.a{a} + w / (w + 1 - {g}) * ({value[a]} - f.a{a})" for a in names] + [f"f.s{a}{b} + ({value[a]} - f.a{a}) * ({value[b]} - f.a{b}) / (w + 1 - {g})" for a, b in pairs])
    columns = ", ".join([f"a{a}" for a in names] + [f"s{a}{b}" for a, b in pairs])
    zeros = ", ".join("0.0::DOUBLE" for _ in [*names, *pairs])
    if degree:
        b, w, rss = "(syo * svv - syv * sov) / (soo * svv - sov * sov)", "svv / (soo * svv - sov * sov)", "syy - (syo * syo * svv - 2 * syo * syv * sov + syv * syv * soo) / (soo * svv - sov * sov)"
    else:
        b, w, rss = "syo / soo", "1 / soo", "syy - syo * syo / soo"
    return f"""WITH RECURSIVE {LONG}, l AS (SELECT site, avg(value) AS level FROM h GROUP BY 1),
x AS (SELECT site, value - level AS y, CAST({LONG_PRED} - t AS DOUBLE) AS v, row_number() OVER (PARTITION BY site ORDER BY t DESC) AS i, count(*) OVER (PARTITION BY site) AS n FROM h JOIN l USING (site)),
f(site, i, p, last, {columns}) AS (SELECT site, 0, 0.0::DOUBLE, 0.0::DOUBLE, {zeros} FROM l UNION ALL
  SELECT site, i, w * (1 - {g}) / (w + 1 - {g}), v, {step.replace('x.', '').replace('f.', '')} FROM (SELECT f.* EXCLUDE (i), x.i, x.y, x.v, f.p + {g} * (x.v - f.last) AS w FROM f JOIN x ON x.site = f.site AND x.i = f.i + 1))
SELECT f.site, round(level + {b}, 3) AS mu, round(sqrt(({rss}) / (n - {degree}) * (1 - {g} + {w})), 3) AS sigma, CAST(n - {1 + degree} AS DOUBLE) AS nu FROM f JOIN l USING (site) JOIN (SELECT DISTINCT site, n FROM x) USING (site) WHERE f.i = n AND n = {_TIMES}"""


def _long(name: str):
    def run(spark, sf) -> DataFrame:
        return rounded(predict.predict(name, star.long_obs(spark, sf), None, replace(OPTIONS, t_pred=LONG_PRED)), 3)

    return run


query(sql_filter(0), "ml_ewma")(_long("ewma"))
query(sql_filter(1), "ml_ewma_linear")(_long("ewma_linear"))
query(f"SELECT site, round(mu, 3) AS mu, round(sigma, 3) AS sigma, nu FROM ({unrounded(SQL['m_quadratic']).replace(OBS, LONG).replace('27 - avg', f'{LONG_PRED} - avg')})", "ml_quadratic")(_long("quadratic"))
for _name in ("spline", "trend"):
    query(None, f"ml_{_name}")(_long(_name))


def _parts(name: str):
    def run(spark, sf) -> DataFrame:
        return rounded(predict.predict(name, star.part_obs(spark, sf), star.part_fcst(spark, sf), replace(OPTIONS, t_pred=13)), 3)

    return run


for _name in ("rawmultimodel", "multimodel_linear_reg", "ewma_linear_model_reg"):
    query(None, f"mp_{_name}")(_parts(_name))


# ---- products, targets, masks, correlations by lead and subset ----

_BOTH = f"""{OBS}, {FCST}, pt AS ({LINE}), pm AS ({MODEL_LINE}), q AS (SELECT site, {sql_hazen('(1.0 / 3)')} AS lower, {sql_hazen('(2.0 / 3)')} AS upper FROM {HAZEN}), cm AS (SELECT site, avg(value) AS clim_mean FROM h GROUP BY 1)"""
_CLASS = "CAST(CASE WHEN {b} > {a} THEN -len(list_filter(range(1, 7), lambda k: {b} > 0.3 + k / 10)) WHEN {a} > {b} THEN len(list_filter(range(1, 7), lambda k: {a} > 0.3 + k / 10)) ELSE 0 END AS INTEGER)"


def _bisected(target: str) -> str:
    return f"CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'tnu')} < {target} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'tnu')} < {target} THEN hi ELSE (lo + hi) / 2 END"


@query(f"""WITH RECURSIVE {_BOTH}, d AS (SELECT pt.site, pt.mu AS tmu, pt.sigma AS tsigma, pt.nu AS tnu, pm.mu AS mmu, pm.sigma AS msigma, pm.nu AS mnu, lower, upper, clim_mean FROM pt JOIN pm USING (site) JOIN q USING (site) JOIN cm USING (site)),
b(site, tnu, lo, hi, k) AS (SELECT site, tnu, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM d UNION ALL SELECT site, tnu, {_bisected('2.0 / 3')}, k + 1 FROM b WHERE k < 50),
e AS (SELECT d.*, tmu - tsigma * (lo + hi) / 2 AS own_lower, tmu + tsigma * (lo + hi) / 2 AS own_upper FROM d JOIN b ON b.site = d.site AND k = 50),
cl AS (SELECT *, {sql_t_cdf('((lower - tmu) / tsigma)', 'tnu')} AS tb, 1 - {sql_t_cdf('((upper - tmu) / tsigma)', 'tnu')} AS ta, {sql_t_cdf('((lower - mmu) / msigma)', 'mnu')} AS mb, 1 - {sql_t_cdf('((upper - mmu) / msigma)', 'mnu')} AS ma, {sql_t_cdf('((own_lower - mmu) / msigma)', 'mnu')} AS ob, 1 - {sql_t_cdf('((own_upper - mmu) / msigma)', 'mnu')} AS oa FROM e)
SELECT site, round(mmu - tmu, 4) AS model_less_trend, round(tmu - clim_mean, 4) AS trend_anomaly, round(mmu - clim_mean, 4) AS model_anomaly, round(100 * (1 - msigma * sqrt(mnu / (mnu - 2)) / (tsigma * sqrt(tnu / (tnu - 2)))), 4) AS sd_reduction,
  {_CLASS.format(b='tb', a='ta')} AS trend_tercile, {_CLASS.format(b='mb', a='ma')} AS model_tercile, {_CLASS.format(b='ob', a='oa')} AS model_trend_tercile FROM cl""")
def v_forecast_maps(spark, sf):
    obs = star.obs_panel(spark, sf)
    model = predict.predict("rawmodel_linear", obs, star.fcst_panel(spark, sf), OPTIONS, star.site_weights(spark, sf))
    return rounded(study.forecast_maps(predict.predict("linear", obs, None, OPTIONS), model, obs.where(f"t < {T_PRED}")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, CAST(year(d + INTERVAL 2 MONTH) AS INTEGER) AS year, CAST(month(d + INTERVAL 2 MONTH) AS INTEGER) AS month, CASE WHEN day(d) > 8 THEN 2 ELSE 3 END AS lag FROM d""")
def f_target_of_date(spark, sf):
    d = star.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select("d", *panel.target_of(F.col("d")))


@query(ZERO.replace("WITH e AS", "WITH RECURSIVE e AS").split("SELECT site, n, round(mean, 6)")[0] + f""", b(site, tnu, lo, hi, k) AS (SELECT site, n_adj - 1, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM y UNION ALL SELECT site, tnu, {_bisected('0.975')}, k + 1 FROM b WHERE k < 50)
SELECT y.site, round(mean, 6) AS mean, round(sd / sqrt(n_adj) * (lo + hi) / 2, 6) AS dt FROM y JOIN b ON b.site = y.site AND k = 50""")
def f_zero_width(spark, sf):
    e = star.table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.datediff("ts", F.lit("2024-01-01")).alias("t")).agg((F.avg("value") - 100).alias("value"))
    return rounded(panel.zero_mean_width(panel.zero_mean_test(e, ["site"])).select("site", "mean", "dt"), 6)


@query(f"WITH {ON_GRID} SELECT CAST(lat * 9 + lon AS BIGINT) AS site, round(greatest(0.0, least(1.0, sum(w * share * 10))), 6) AS share FROM x GROUP BY 1")
def s_land_share(spark, sf):
    d = star.table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("int") % 10).alias("lat"), (F.col("l_partkey") % 12).cast("int").alias("lon")).agg(((F.avg("l_discount") + 0.01) * 10).alias("value"))
    return rounded(readers.land_share(d, _grid_weights(spark), 9), 6)


@query(f"""WITH {OBS}, {FCST}, fl AS (SELECT site, t + lag - 1 AS t, lag, m FROM fm, (SELECT unnest([1, 2]) AS lag)), s0 AS (SELECT DISTINCT t FROM fl), sd AS (SELECT t, unnest([1, 2]) AS seed FROM s0),
k AS (SELECT seed, t, t % 4 AS season, row_number() OVER (PARTITION BY seed, t % 4 ORDER BY t) AS i, row_number() OVER (PARTITION BY seed, t % 4 ORDER BY md5(seed || ':' || t)) AS jj FROM sd),
o AS (SELECT 0 AS seed, t, t AS other FROM s0 UNION ALL SELECT a.seed, a.t, b.t AS other FROM k a JOIN k b ON a.seed = b.seed AND a.season = b.season AND a.i = b.jj),
r AS (SELECT lag, seed, obs.site, obs.t % 4 AS season, corr(obs.value, fl.m) AS r, corr(obs.value, obs.t) AS ry, corr(fl.m, obs.t) AS rx FROM o JOIN fl ON fl.t = o.other JOIN obs ON obs.site = fl.site AND obs.t = o.t GROUP BY 1, 2, 3, 4),
z AS (SELECT *, (r - ry * rx) / sqrt((1 - ry * ry) * (1 - rx * rx)) AS rd FROM r), ws AS (SELECT site, w, unnest(['all', CASE WHEN n_regionkey <= 1 THEN 'inside' ELSE 'outside' END]) AS subset FROM w JOIN nation ON n_nationkey = site)
SELECT CAST(lag AS INTEGER) AS lag, subset, CAST(seed AS INTEGER) AS seed, CAST(season AS INTEGER) AS season, round(sum(w * r) / sum(w), 6) AS r, round(sum(w * rd) / sum(w), 6) AS r_detrended FROM z JOIN ws USING (site) GROUP BY 1, 2, 3, 4""")
def v_correlation_study(spark, sf):
    fcst = star.fcst_leads(spark, sf).groupBy("site", "t", "lag").agg(F.avg("value").alias("value"))
    inside = F.when(F.col("n_regionkey") <= 1, "inside").otherwise("outside")
    nations = star.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("site"), F.explode(F.array(F.lit("all"), inside)).alias("subset"))
    return rounded(study.correlation_study(star.obs_panel(spark, sf), fcst, 4, star.site_weights(spark, sf).join(nations, "site"), [1, 2]), 6)


# ---- a gridded data set with missing numbers, filled along longitudes, then latitudes ----


@query(f"""WITH {QUANTITIES}, g0 AS (SELECT year, month, lat, lon, CASE WHEN (3 * lat + lon + month) % 7 > 0 AND lat % 11 <> 5 THEN value END AS value FROM (SELECT DISTINCT year, month FROM u) CROSS JOIN (SELECT unnest(range(0, 50)) AS lat) CROSS JOIN (SELECT unnest(range(0, 4)) AS lon) LEFT JOIN u USING (year, month, lat, lon)),
turned AS (SELECT year, month, lat, lon + 4 * c AS lon, value FROM g0, (SELECT unnest([-1, 0, 1]) AS c) WHERE value IS NOT NULL),
g1 AS (SELECT year, month, lat, lon, coalesce(value, (SELECT v.value FROM turned v WHERE v.year = g.year AND v.month = g.month AND v.lat = g.lat ORDER BY abs(v.lon - g.lon), v.lon LIMIT 1)) AS value FROM g0 g),
g2 AS (SELECT year, month, lat, lon, coalesce(value, (SELECT v.value FROM g1 v WHERE v.value IS NOT NULL AND v.year = g.year AND v.month = g.month AND v.lon = g.lon ORDER BY abs(v.lat - g.lat), v.lat LIMIT 1)) AS value FROM g1 g)
SELECT g2.year, g2.month, CAST(lat // 10 AS INTEGER) AS lat, CAST(lon // 2 AS INTEGER) AS lon, CASE WHEN avg(CASE WHEN g0.value IS NULL THEN 0 ELSE 1 END) >= 0.5 THEN round(avg(g2.value), 6) END AS value FROM g2 JOIN g0 USING (year, month, lat, lon) GROUP BY 1, 2, 3, 4""")
def s_cams(spark, sf):
    l = star.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_quantity").cast("int") - 1).alias("lat"), (F.col("l_linenumber").cast("int") % 4).alias("lon"))
    u = l.groupBy("year", "month", "lat", "lon").agg(F.count("*").cast("double").alias("value"))
    cells = u.select("year", "month").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("lat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lon"))
    there = ((3 * F.col("lat") + F.col("lon") + F.col("month")) % 7 > 0) & (F.col("lat") % 11 != 5) & F.col("value").isNotNull()
    d = cells.join(u, ["year", "month", "lat", "lon"], "left").withColumn("value", F.when(there, F.col("value")).otherwise(-999.0))
    axes = {"lat": regrid.overlap_weights(regrid.axis_cells(spark, [float(i) for i in range(51)]), regrid.axis_cells(spark, [10.0 * i for i in range(6)])), "lon": regrid.overlap_weights(regrid.axis_cells(spark, [float(i) for i in range(5)]), regrid.axis_cells(spark, [0.0, 2.0, 4.0]))}
    return rounded(readers.read_observations(d, "cams", axes, period=4), 6)


# ---- usual time scales, last values, predictions at points ----

_EW = unrounded(METHODS["ewma"]).replace(repr(OPTIONS.gamma), repr(1 / 226))


@query(f"""WITH c AS ({unrounded(METHOD_SQL['history'])}), m AS ({unrounded(METHOD_SQL['ma']).replace('27 - t <= 12', '27 - t <= 30')}), e AS ({_EW})
SELECT site, method, round(mu, 4) AS mu, round(sigma, 4) AS sigma, nu FROM (SELECT 'C' AS method, * FROM c UNION ALL SELECT 'MA', * FROM m UNION ALL SELECT 'EW', * FROM e)""")
def o_usual_methods(spark, sf):
    return rounded(predict.predict_usual(["C", "MA", "EW"], star.obs_panel(spark, sf), None, OPTIONS))


@query(f"WITH {OBS} SELECT site, round(avg(value), 4) AS mu, round(stddev_samp(value), 4) AS sigma, CAST(count(*) - 1 AS DOUBLE) AS nu FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY site ORDER BY t DESC) <= 8) GROUP BY 1")
def w_last_values(spark, sf):
    return rounded(predict.last_values(star.obs_panel(spark, sf).where(f"t < {T_PRED}"), 8))


@query(f"""WITH {OBS_SUPPLIER}, pr AS ({_plain(sql_moments('h', 'value'))}), {PLACES}, d AS (SELECT id, g.site, {HAVERSINE} AS d, mu, sigma, nu FROM p, g JOIN pr ON pr.site = g.site)
SELECT id, round(sum(exp(-d / 2) * mu) / sum(exp(-d / 2)), 3) AS mu, round(sum(exp(-d / 2) * sigma) / sum(exp(-d / 2)), 3) AS sigma, round(sum(exp(-d / 2) * nu) / sum(exp(-d / 2)), 3) AS nu FROM d WHERE d < 8 GROUP BY id HAVING min(d) <= 3""")
def r_predictions_at_points(spark, sf):
    points, grid = _places(spark, sf)
    pred = predict.predict("history", star.supplier_obs(spark, sf), None, OPTIONS)
    return rounded(regrid.distance_weighted(points, grid, pred, scale=2.0, nearest=3.0, columns=("mu", "sigma", "nu")), 3)


# ---- hyperslabs of flat files ----


@query(f"""WITH {QUANTITIES}, g AS (SELECT year, month, lat, lon FROM (SELECT DISTINCT year FROM u) CROSS JOIN (SELECT unnest([3, 4, 5]) AS month) CROSS JOIN (SELECT unnest(range(10, 30)) AS lat) CROSS JOIN (SELECT unnest(range(0, 4)) AS lon))
SELECT g.year, CAST(g.month AS INTEGER) AS month, CAST(g.lat AS INTEGER) AS lat, CAST(g.lon AS INTEGER) AS lon, value FROM g LEFT JOIN u USING (year, month, lat, lon) WHERE g.year > 1992""")
def s_hyperslab(spark, sf):
    path = hyperslab.shared_folder(spark)
    hyperslab.write_hyperslabs(_shipments(spark, sf), path, 4, 50)
    return hyperslab.read_hyperslab(spark, path, 4, 50, years=(1993, 9999), months=[3, 4, 5], lats=(10, 29))


def _shipments(spark, sf) -> DataFrame:
    """year, month, lat, lon, value: lines shipped in a month by quantity and line number."""
    l = star.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_quantity").cast("int") - 1).alias("lat"), (F.col("l_linenumber").cast("int") % 4).alias("lon"))
    return l.groupBy("year", "month", "lat", "lon").agg(F.count("*").cast("double").alias("value"))
