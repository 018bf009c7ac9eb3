"""Queries of readers, studies and products over the supplied tables, with their SQL; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.functions import special
from foretide.operators import panel, regrid
from foretide.plans import predict, study, targets, verify
from foretide.queries import FCST, HAZEN, METHOD_SQL, OBS, OPTIONS, PRED, SQL, SUMMARY, T_PRED, _plain, _predictions, _scored, query, rounded, sql_by_supplier, sql_hazen, sql_line, sql_t_cdf
from foretide.sources import readers, star

LINE = _plain(sql_line("h", "value", "t", "27"))
MODEL_LINE = _plain(sql_line("j", "(y - m)", "t", "27"))

# the methods whose normal equations are orthogonal by the shared design
SQL["m_quadratic"] = f"""WITH {OBS}, u AS (SELECT *, t - avg(t) OVER s AS p, count(*) OVER s AS n FROM h WINDOW s AS (PARTITION BY site)),
v AS (SELECT *, p * p - avg(p * p) OVER s - p * (sum(p * p * p) OVER s) / (sum(p * p) OVER s) AS q, 27 - avg(t) OVER s AS a1, avg(p * p) OVER s AS pp, (sum(p * p * p) OVER s) / (sum(p * p) OVER s) AS k FROM u WINDOW s AS (PARTITION BY site)),
f AS (SELECT site, count(*) AS n, avg(value) AS y0, sum(p * value) / sum(p * p) AS b1, sum(q * value) / sum(q * q) AS b2, any_value(a1) AS a1, any_value(a1 * a1 - pp - a1 * k) AS a2, sum(p * p) AS s1, sum(q * q) AS s2, var_pop(value) * count(*) AS syy FROM v GROUP BY site)
SELECT site, round(y0 + b1 * a1 + b2 * a2, 4) AS mu, round(sqrt((syy - b1 * b1 * s1 - b2 * b2 * s2) / (n - 3) * (1 + 1.0 / n + a1 * a1 / s1 + a2 * a2 / s2)), 4) AS sigma, CAST(n - 3 AS DOUBLE) AS nu FROM f WHERE n = (SELECT count(DISTINCT t) FROM h)"""
SQL["ms_quadratic"] = sql_by_supplier(SQL["m_quadratic"], False)


@query(f"""WITH RECURSIVE {OBS}, p AS ({LINE}), q AS (SELECT *, unnest([0.05, 0.5, 0.9]) AS prob FROM p),
b(site, mu, sigma, nu, prob, lo, hi, k) AS (SELECT site, mu, sigma, nu, prob, CAST(-100 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM q UNION ALL
  SELECT site, mu, sigma, nu, prob, CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'nu')} < prob THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'nu')} < prob THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 50)
SELECT site, CAST(prob AS DOUBLE) AS prob, round((lo + hi) / 2, 6) + 0 AS t_quantile, round(mu + sigma * (lo + hi) / 2, 2) AS value FROM b WHERE k = 50""")
def f_predictive_quantiles(spark, sf):
    p = predict.predict("linear", star.obs_panel(spark, sf), None, OPTIONS).select("*", F.explode(F.array(*map(F.lit, (0.05, 0.5, 0.9)))).alias("prob"))
    x = special.t_ppf(F.col("prob"), F.col("nu"))
    return p.select("site", "prob", F.round(x, 6).alias("t_quantile"), F.round(F.col("mu") + F.col("sigma") * x, 2).alias("value"))


RECORDS = f"""{OBS}, {FCST}, pt AS ({LINE}), pm AS ({MODEL_LINE}),
r AS (SELECT obs.site, obs.value, l.level, l.n, w.w, obs.value > l.level AS rec, {sql_t_cdf('((pt.mu - l.level) / pt.sigma)', 'pt.nu')} AS p_t, {sql_t_cdf('((pm.mu - l.level) / pm.sigma)', 'pm.nu')} AS p_m
  FROM obs JOIN (SELECT site, max(value) AS level, count(*) AS n FROM h GROUP BY 1) l USING (site) JOIN pt ON pt.site = obs.site JOIN pm ON pm.site = obs.site JOIN w ON w.site = obs.site WHERE obs.t = 27),
rc AS (SELECT *, 1.0 / (n + 1) AS p_s, least(greatest(p_m, min(p_t) OVER ()), max(p_t) OVER ()) AS p_c FROM r)"""
NLL = "round(sum(w * -(CASE WHEN rec THEN ln({p}) ELSE ln(1 - {p}) END)) / sum(w), 6)"
RECORD_COLUMNS = "round(sum(w * p_s) / sum(w), 6) AS expected, round(sum(CASE WHEN rec THEN w ELSE 0 END) / sum(w), 6) AS actual, " + ", ".join(f"{NLL.format(p=p)} AS nll_{n}" for p, n in (("p_s", "stationary"), ("p_t", "trend"), ("p_m", "model"), ("p_c", "clipped")))


def _record_scores(spark, sf, by=None) -> DataFrame:
    obs, fcst, weights = star.obs_panel(spark, sf), star.fcst_panel(spark, sf), star.site_weights(spark, sf)
    if by:
        weights = weights.join(star.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("site"), (F.col("n_regionkey") <= 1).alias("region")), "site")
    trend, model = predict.predict("linear", obs, None, OPTIONS), predict.predict("rawmodel_linear", obs, fcst, OPTIONS, star.site_weights(spark, sf))
    return rounded(study.record_scores(obs, trend, model, T_PRED, weights, by), 6)


@query(f"WITH {RECORDS} SELECT {RECORD_COLUMNS} FROM rc")
def v_record_scores(spark, sf):
    return _record_scores(spark, sf)


@query(f"WITH {RECORDS} SELECT n_regionkey <= 1 AS region, {RECORD_COLUMNS} FROM rc JOIN nation ON n_nationkey = rc.site GROUP BY 1")
def v_record_scores_by_region(spark, sf):
    return _record_scores(spark, sf, ["region"])


SERIES = f"{OBS}, wt0 AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1), g AS (SELECT t, sum(w * value) / sum(w) AS value FROM obsm JOIN wt0 USING (site) GROUP BY t)"


@query(f"""WITH RECURSIVE {SERIES}, d AS (SELECT t - avg(t) OVER s AS x, value - avg(value) OVER s AS y, t % 12 AS season FROM g WINDOW s AS (PARTITION BY t % 12)),
f AS (SELECT sum(x * y) / sum(x * x) AS slope, CAST(count(*) - count(DISTINCT season) - 1 AS DOUBLE) AS dof, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM d),
b(dof, lo, hi, k) AS (SELECT dof, CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 0 FROM f UNION ALL SELECT dof, CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'dof')} < 0.975 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {sql_t_cdf('((lo + hi) / 2)', 'dof')} < 0.975 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 50)
SELECT round(slope, 4) AS slope, round(slope - (lo + hi) / 2 * sqrt((yy - slope * xy) / f.dof / xx), 4) AS low, round(slope + (lo + hi) / 2 * sqrt((yy - slope * xy) / f.dof / xx), 4) AS high, f.dof FROM f, b WHERE k = 50""")
def v_seasonal_trend(spark, sf):
    d = star.obs_panel(spark, sf, True).join(star.site_weights(spark, sf), "site").groupBy("t").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return rounded(study.seasonal_trend(d, 12))


@query(f"""WITH {OBS}, {FCST}, s0 AS (SELECT DISTINCT t FROM fm), sd AS (SELECT t, unnest([1, 2]) AS seed FROM s0),
k AS (SELECT seed, t, t % 4 AS season, row_number() OVER (PARTITION BY seed, t % 4 ORDER BY t) AS i, row_number() OVER (PARTITION BY seed, t % 4 ORDER BY md5(seed || ':' || t)) AS jj FROM sd),
o AS (SELECT 0 AS seed, t, t AS other FROM s0 UNION ALL SELECT a.seed, a.t, b.t AS other FROM k a JOIN k b ON a.seed = b.seed AND a.season = b.season AND a.i = b.jj),
r AS (SELECT seed, obs.site, obs.t % 4 AS season, corr(obs.value, fm.m) AS r FROM o JOIN fm ON fm.t = o.other JOIN obs ON obs.site = fm.site AND obs.t = o.t GROUP BY 1, 2, 3)
SELECT CAST(seed AS INTEGER) AS seed, CAST(season AS INTEGER) AS season, round(sum(w * r) / sum(w), 6) AS r FROM r JOIN w USING (site) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1, 2""")
def v_correlations(spark, sf):
    fcst = star.fcst_panel(spark, sf).groupBy("site", "t").agg(F.avg("value").alias("value"))
    return rounded(study.correlations(star.obs_panel(spark, sf), fcst, 4, star.site_weights(spark, sf), [1, 2]), 6)


CLIM = "clim AS (SELECT site, avg(value) AS mean, stddev_samp(value) AS sd FROM obs WHERE t < 20 GROUP BY 1)"


@query(f"""WITH {PRED}, {CLIM}, e AS (SELECT list_sort(list(mean)) AS s, count(*) AS n FROM clim), cut AS (SELECT [{', '.join(sql_hazen(f'({k} / 5.0)') for k in range(1, 5))}] AS edges FROM e),
k AS (SELECT site, CAST(1 + len(list_filter(edges, lambda x: x <= mean)) AS INTEGER) AS class FROM clim, cut)
SELECT class, {SUMMARY} FROM sc JOIN k USING (site) GROUP BY 1""")
def v_skill_by_climate(spark, sf):
    clim = star.obs_panel(spark, sf).where("t < 20").groupBy("site").agg(F.avg("value").alias("mean"))
    return rounded(study.skill_by_climate(_scored(spark, sf), clim, 5))


BOUNDS = ", ".join(repr(b) for b in verify.category_bounds())
PLACED = f"""{PRED}, {CLIM}, lv AS (SELECT list_concat(list_concat([CAST('-infinity' AS DOUBLE)], [{BOUNDS}]), [CAST('infinity' AS DOUBLE)]) AS b),
pl AS (SELECT obs.site, obs.t, mean, sd, CAST(greatest(1, ceil(100 * {sql_t_cdf('((value - mean) / sd)', '99.0')})) AS INTEGER) AS category FROM obs JOIN clim USING (site)),
pc AS (SELECT pl.*, mean + sd * b[category] AS low, mean + sd * b[category + 1] AS high FROM pl, lv)"""


def _clim(spark, sf) -> DataFrame:
    return star.obs_panel(spark, sf).where("t < 20").groupBy("site").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


@query(f"""WITH {PLACED}, x AS (SELECT category, w, CASE WHEN category = 100 THEN 1.0 ELSE {sql_t_cdf('((high - mu) / sigma)', 'nu')} END - CASE WHEN category = 1 THEN 0.0 ELSE {sql_t_cdf('((low - mu) / sigma)', 'nu')} END AS p FROM pr JOIN pc USING (site, t) JOIN wt USING (site))
SELECT category, round(sum(w * p) / sum(w), 6) AS prob, round(sum(w * -ln(p)) / sum(w), 5) AS nll, count(*) AS n FROM x GROUP BY 1""")
def v_categories(spark, sf):
    placed = verify.climatology_category(star.obs_panel(spark, sf), _clim(spark, sf)).select("site", "t", "category", "low", "high")
    d = verify.category_scores(_predictions(spark, sf), placed, ["site", "t"], [], star.site_weights(spark, sf))
    return d.select("category", F.round("prob", 6).alias("prob"), F.round("nll", 5).alias("nll"), "n")


@query(f"""WITH {PLACED}, q AS (SELECT unnest(range(1, 100)) AS category), y AS (SELECT q.category, pr.t, sum(w * {sql_t_cdf('((mean + sd * b[q.category + 1] - mu) / sigma)', 'nu')}) / sum(w) AS below FROM pr JOIN clim USING (site) JOIN wt USING (site), q, lv GROUP BY 1, 2),
z AS (SELECT category, avg(below) AS below FROM y GROUP BY 1 UNION ALL SELECT 100, 1.0), f AS (SELECT category, below - lag(below, 1, 0.0) OVER (ORDER BY category) AS freq FROM z),
o2 AS (SELECT category, count(*) AS n FROM pl WHERE t >= 20 GROUP BY 1)
SELECT CAST(f.category AS INTEGER) AS category, round(freq, 6) AS freq_for, round(coalesce(n, 0) / (SELECT sum(n) FROM o2), 6) AS freq_obs FROM f LEFT JOIN o2 ON o2.category = f.category""")
def v_category_frequencies(spark, sf):
    clim, obs = _clim(spark, sf), star.obs_panel(spark, sf)
    seen = verify.observed_frequencies(verify.climatology_category(obs.where("t >= 20"), clim)).withColumnRenamed("freq", "freq_obs")
    return rounded(verify.forecast_frequencies(_predictions(spark, sf), clim, [], weights=star.site_weights(spark, sf)).withColumnRenamed("freq", "freq_for").join(seen, "category"), 6)


@query(f"""WITH {PRED}, mk AS (SELECT CAST(n_nationkey AS BIGINT) AS site, n_regionkey / 4.0 AS share FROM nation), x AS (SELECT sc.* EXCLUDE (w), unnest([true, false]) AS inside, w, share FROM sc JOIN mk USING (site)),
y AS (SELECT * EXCLUDE (w), w * CASE WHEN inside THEN share ELSE 1 - share END AS w FROM x) SELECT inside, {SUMMARY} FROM y WHERE w > 0 GROUP BY 1""")
def v_masked_scores(spark, sf):
    mask, weights = star.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("site"), (F.col("n_regionkey") / 4.0).alias("share")), star.site_weights(spark, sf)
    pred, obs = _predictions(spark, sf), star.obs_panel(spark, sf)
    out = None
    for inside in (True, False):
        part = verify.summary(verify.scored(pred, obs, ["site", "t"], verify.masked_weights(weights, mask, inside)), []).withColumn("inside", F.lit(inside))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(f"""WITH {PRED.replace('range(20, 28)', 'range(26, 28)')}, hp AS (SELECT o.site, tt.tp AS t, count(*) - 1.0 AS nu, avg(value) AS mu, stddev_samp(value) AS sigma FROM obs o JOIN tt ON o.t < tt.tp GROUP BY 1, 2),
al AS (SELECT 'linear' AS method, site, t, mu, sigma, nu FROM pr UNION ALL SELECT 'history', site, t, mu, sigma, nu FROM hp)
SELECT method, al.t, round(sqrt(sum(w * pow(mu - value, 2)) / sum(w)), 4) AS rmse, round(sum(w * (mu - value)) / sum(w), 4) AS bias FROM al JOIN obs ON obs.site = al.site AND obs.t = al.t JOIN wt ON wt.site = al.site GROUP BY 1, 2""")
def v_methods(spark, sf):
    s = study.verify_methods(star.obs_panel(spark, sf), None, ["history", "linear"], [26, 27], OPTIONS, star.site_weights(spark, sf))
    return rounded(verify.summary(s, ["method", "t"]).select("method", "t", "rmse", "bias"))


@query(name="v_targets")  # its SQL is in method_sql
def v_targets(spark, sf):
    """All methods of one plan at eight targets and two leads."""
    s = study.verify_methods(star.obs_panel(spark, sf), star.fcst_leads(spark, sf), list(targets.LINES), list(range(20, 28)), OPTIONS, star.site_weights(spark, sf), [1, 2])
    g = s.groupBy("method", "lag", "t").agg(F.count("*").alias("n"), *((F.sum(F.col("w") * e) / F.sum("w")).alias(n) for n, e in (("square", F.col("error") * F.col("error")), ("bias", F.col("error")), ("nll", F.col("nll")))))
    return g.select("method", "lag", "t", "n", F.round(F.sqrt("square"), 4).alias("rmse"), F.round("bias", 4).alias("bias"), F.round("nll", 6).alias("nll"))


@query("""WITH a AS (SELECT CAST(l_quantity AS INTEGER) AS idx, -90.0 + 3.5 * CAST(l_quantity AS INTEGER) + avg(l_discount) AS centre FROM lineitem GROUP BY l_quantity),
l AS (SELECT idx, coalesce((lag(centre) OVER o + centre) / 2, -90.0) AS lo, coalesce((lead(centre) OVER o + centre) / 2, 90.0) AS hi FROM a WINDOW o AS (ORDER BY idx))
SELECT idx, round(lo, 9) AS lo, round(hi, 9) AS hi, round(sin(radians(hi)) - sin(radians(lo)), 9) AS area FROM l""")
def p_cell_limits(spark, sf):
    quantity = F.col("l_quantity").cast("int")
    axis = star.table(spark, sf, "lineitem").groupBy(quantity.alias("idx")).agg(F.avg("l_discount").alias("d")).select("idx", (-90.0 + 3.5 * F.col("idx") + F.col("d")).alias("centre"))
    d = regrid.cell_limits(axis, -90.0, 90.0)
    return d.select("idx", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round(regrid.cell_area(F.col("lo"), F.col("hi")), 9).alias("area"))


@query("SELECT c_custkey, CAST(greatest(0, least(20, round((c_acctbal + 1000) / 500))) AS INTEGER) AS cell FROM customer")
def j_nearest_index(spark, sf):
    return star.table(spark, sf, "customer").select("c_custkey", regrid.nearest_index(F.col("c_acctbal"), -1000.0, 500.0, 21).alias("cell"))


@query("""WITH p AS (SELECT c_custkey, CAST(c_custkey % 179 AS DOUBLE) - 89 AS lat, CAST(c_custkey % 359 AS DOUBLE) AS lon FROM customer)
SELECT c_custkey, round(degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(10 - lon) / 2), 2))))), 6) AS distance FROM p""")
def f_distance(spark, sf):
    c = star.table(spark, sf, "customer")
    lat, lon = (F.col("c_custkey") % 179).cast("double") - 89, (F.col("c_custkey") % 359).cast("double")
    return c.select("c_custkey", F.round(special.haversine(lat, lon, F.lit(40.0), F.lit(10.0)), 6).alias("distance"))


def sql_norm_ppf(p: str) -> str:
    def horner(x: str, terms) -> str:
        out = repr(terms[0])
        for c in terms[1:]:
            out = f"({out} * {x} + {c!r})"
        return out

    q, tail = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{horner(tail, special._C)} / {horner(tail, special._D)}"
    return f"CASE WHEN {p} BETWEEN 0.02425 AND 0.97575 THEN {horner(f'({q} * {q})', special._A)} * {q} / {horner(f'({q} * {q})', special._B)} WHEN {p} < 0.5 THEN {outer} ELSE -({outer}) END"


SQL["b_normal_scores"] = f"""WITH {OBS}, r AS (SELECT site, t, value, rank() OVER (PARTITION BY site ORDER BY value) + (count(*) OVER (PARTITION BY site, value) - 1) / 2 AS avg_rank, count(*) OVER (PARTITION BY site) AS n FROM h)
SELECT site, t, round(value, 6) AS value, avg_rank, round({sql_norm_ppf('(avg_rank / (n + 1))')}, 6) AS score FROM r"""

SQL["b_transform_scores"] = f"""WITH {OBS}, r AS (SELECT site, value, rank() OVER (PARTITION BY site ORDER BY value) AS r, count(*) OVER (PARTITION BY site) AS n FROM obs WHERE t < 26),
k AS (SELECT site, list(value ORDER BY value) AS x, list({sql_norm_ppf('(r / (n + 1.0))')} ORDER BY value) AS s, count(*) AS n FROM r GROUP BY site),
o AS (SELECT *, greatest(1, least(n - 1, len(list_filter(x, lambda e: e <= value)))) AS i, count(*) OVER (PARTITION BY site) AS m FROM obs JOIN k USING (site) WHERE t >= 26),
f AS (SELECT *, s[i] + (value - x[i]) * (s[i + 1] - s[i]) / (x[i + 1] - x[i]) AS score, -{sql_norm_ppf('(1 / (n + m + 1.0))')} AS top FROM o)
SELECT site, t, round(value, 6) AS value, round(greatest(-top, least(top, score)), 6) AS score FROM f"""


QUANTITIES = "u AS (SELECT CAST(extract(year FROM l_shipdate) AS INTEGER) AS year, CAST(extract(month FROM l_shipdate) AS INTEGER) AS month, CAST(l_quantity AS INTEGER) - 1 AS lat, CAST(l_linenumber AS INTEGER) % 4 AS lon, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {QUANTITIES}, g AS (SELECT year, month, lat, lon, CASE WHEN (lat + lon + month) % 7 > 0 THEN value END AS value FROM (SELECT DISTINCT year, month FROM u) CROSS JOIN (SELECT unnest(range(0, 50)) AS lat) CROSS JOIN (SELECT unnest(range(0, 4)) AS lon) LEFT JOIN u USING (year, month, lat, lon)),
m AS (SELECT year, month, lat, avg(value) AS mean FROM g GROUP BY 1, 2, 3),
f AS (SELECT g.year, g.month, g.lat, g.lon, coalesce(g.value, (SELECT k.mean FROM m k WHERE k.year = g.year AND k.month = g.month AND k.mean IS NOT NULL ORDER BY abs(k.lat - g.lat), k.lat LIMIT 1)) AS value FROM g)
SELECT year, month, CAST(lat // 10 AS INTEGER) AS lat, CAST(lon // 2 AS INTEGER) AS lon, round(avg(value), 6) AS value FROM f GROUP BY 1, 2, 3, 4""")
def s_observations(spark, sf):
    l = star.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_quantity").cast("int") - 1).alias("lat"), (F.col("l_linenumber").cast("int") % 4).alias("lon"))
    u = l.groupBy("year", "month", "lat", "lon").agg(F.count("*").cast("double").alias("value"))
    cells = u.select("year", "month").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("lat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lon"))
    d = cells.join(u, ["year", "month", "lat", "lon"], "left").withColumn("value", F.when((F.col("lat") + F.col("lon") + F.col("month")) % 7 > 0, F.col("value")))
    axes = {"lat": regrid.overlap_weights(regrid.axis_cells(spark, [float(i) for i in range(51)]), regrid.axis_cells(spark, [10.0 * i for i in range(6)])), "lon": regrid.overlap_weights(regrid.axis_cells(spark, [float(i) for i in range(5)]), regrid.axis_cells(spark, [0.0, 2.0, 4.0]))}
    return rounded(readers.read_observations(d, "best", axes), 6)


@query("""WITH r AS (SELECT l_linestatus || l_returnflag AS model, CAST(l_quantity AS BIGINT) AS site, date_trunc('month', l_shipdate) AS target, date_trunc('month', l_shipdate) - to_months(CAST(l_orderkey % 3 AS INTEGER)) AS init, CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS value FROM lineitem)
SELECT model, site, CAST(year(target) AS INTEGER) AS year, CAST(month(target) AS INTEGER) AS month, round(ln(avg(value)), 9) AS vals_mean, round(ln(stddev_samp(value)), 9) AS vals_sd, count(value) AS nr FROM r WHERE init = target - INTERVAL 1 MONTH GROUP BY 1, 2, 3, 4""")
def s_forecasts(spark, sf):
    l = star.table(spark, sf, "lineitem")
    init = F.add_months(F.trunc("l_shipdate", "month"), -(F.col("l_orderkey") % 3).cast("int"))
    value = F.when(F.col("l_linenumber") == 5, 1e21).when(F.col("l_linenumber") == 6, -1.0).otherwise(F.col("l_extendedprice"))
    raw = l.select(F.concat("l_linestatus", "l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("site"), F.year(init).alias("init_year"), F.month(init).alias("init_month"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_linenumber").alias("member"), value.alias("value"))
    d = readers.read_forecasts(raw, 1)
    return d.select("model", "site", "year", "month", F.round(F.log("vals_mean"), 9).alias("vals_mean"), F.round(F.log("vals_sd"), 9).alias("vals_sd"), "nr")


# ---- places on the sphere ----

HAVERSINE = "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon) / 2), 2)))))"
PLACES = """p AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 1741 AS DOUBLE) / 10 - 87 AS lat, CAST(c_custkey * 13 % 3593 AS DOUBLE) / 10 AS lon FROM customer),
g AS (SELECT s_suppkey AS site, CAST(s_suppkey * 29 % 171 AS DOUBLE) - 85 AS glat, CAST(s_suppkey * 37 % 359 AS DOUBLE) AS glon, s_acctbal AS value FROM supplier)"""


def _places(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers set down on the sphere by their keys."""
    c, s = star.table(spark, sf, "customer"), star.table(spark, sf, "supplier")
    at = lambda key, by, over: (F.col(key) * by % over).cast("double")
    points = c.select(F.col("c_custkey").alias("id"), (at("c_custkey", 7, 1741) / 10 - 87).alias("lat"), (at("c_custkey", 13, 3593) / 10).alias("lon"))
    return points, s.select(F.col("s_suppkey").alias("site"), (at("s_suppkey", 29, 171) - 85).alias("lat"), at("s_suppkey", 37, 359).alias("lon"), F.col("s_acctbal").alias("value"))


@query(f"WITH {PLACES}, d AS (SELECT id, site, {HAVERSINE} AS d FROM p, g) SELECT id, site, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, site) = 1")
def j_nearest_cell(spark, sf):
    points, grid = _places(spark, sf)
    return rounded(regrid.nearest_cell(points, grid, 10.0), 6)


@query(f"WITH {PLACES}, d AS (SELECT id, value, {HAVERSINE} AS d FROM p, g) SELECT id, round(sum(exp(-d / 2) * value) / sum(exp(-d / 2)), 4) AS value FROM d WHERE d < 8 AND value IS NOT NULL GROUP BY id HAVING min(d) <= 3")
def r_distance_weighted(spark, sf):
    points, grid = _places(spark, sf)
    return rounded(regrid.distance_weighted(points, grid, grid, scale=2.0, nearest=3.0))


# ---- more grids: periodic axes, weights, equal areas ----

CELLS = """c AS (SELECT CAST(l_quantity AS INTEGER) % 10 AS lat, CAST(l_partkey % 12 AS INTEGER) AS lon, avg(l_extendedprice) AS value, avg(l_discount) + 0.01 AS share FROM lineitem GROUP BY 1, 2)"""


def sql_overlap(name: str, old: str, new: str, period: str = "") -> str:
    """CTE of src, dst, w between the axes old and new (idx, lo, hi)."""
    turned = f"(SELECT idx, lo + {period} * s AS lo, hi + {period} * s AS hi FROM {old}, (SELECT unnest([-1, 0, 1]) AS s))" if period else old
    part = f"SELECT o.idx AS src, n.idx AS dst, sum(least(o.hi, n.hi) - greatest(o.lo, n.lo)) AS part FROM {turned} o JOIN {new} n ON o.lo < n.hi AND n.lo < o.hi GROUP BY 1, 2"
    return f"{name} AS (SELECT src, dst, part / sum(part) OVER (PARTITION BY dst) AS w FROM ({part}))"


def _cells(spark, sf) -> DataFrame:
    d = star.table(spark, sf, "lineitem")
    return d.groupBy((F.col("l_quantity").cast("int") % 10).alias("lat"), (F.col("l_partkey") % 12).cast("int").alias("lon")).agg(F.avg("l_extendedprice").alias("value"), (F.avg("l_discount") + 0.01).alias("share"))


OLD_LON = "ol AS (SELECT i AS idx, 30.0 * i AS lo, 30.0 * i + 30 AS hi FROM range(0, 12) r(i))"
NEW_LON = "nl AS (SELECT i AS idx, 40.0 * i - 20 AS lo, 40.0 * i + 20 AS hi FROM range(0, 9) r(i))"
OLD_LAT = "oa AS (SELECT i AS idx, sin(radians(18.0 * i - 90)) AS lo, sin(radians(18.0 * i - 72)) AS hi FROM range(0, 10) r(i))"
NEW_LAT = "na AS (SELECT i AS idx, sin(radians(30.0 * i - 90)) AS lo, sin(radians(30.0 * i - 60)) AS hi FROM range(0, 6) r(i))"
ON_GRID = f"{CELLS}, {OLD_LON}, {NEW_LON}, {OLD_LAT}, {NEW_LAT}, {sql_overlap('wl', 'ol', 'nl', '360')}, {sql_overlap('wa', 'oa', 'na')}, x AS (SELECT CAST(wa.dst AS INTEGER) AS lat, CAST(wl.dst AS INTEGER) AS lon, wa.w * wl.w AS w, value, share FROM c JOIN wa ON c.lat = wa.src JOIN wl ON c.lon = wl.src)"


def _grid_weights(spark) -> dict[str, DataFrame]:
    lat = [regrid.axis_cells(spark, regrid.sine_limits([-90.0 + step * i for i in range(round(180 / step) + 1)])) for step in (18.0, 30.0)]
    lon = [regrid.axis_cells(spark, [30.0 * i for i in range(13)]), regrid.axis_cells(spark, [40.0 * i - 20 for i in range(10)])]
    return {"lat": regrid.overlap_weights(*lat), "lon": regrid.overlap_weights(*lon, 360.0)}


@query(f"WITH {ON_GRID} SELECT lat, lon, round(sum(w * value), 4) AS value FROM x GROUP BY 1, 2")
def r_periodic(spark, sf):
    return rounded(regrid.regrid(_cells(spark, sf).select("lat", "lon", "value"), _grid_weights(spark)))


@query(f"WITH {ON_GRID} SELECT lat, lon, round(sum(w * value * share) / sum(w * share), 4) AS value FROM x GROUP BY 1, 2")
def r_weighted(spark, sf):
    return rounded(regrid.weighted_regrid(_cells(spark, sf), _grid_weights(spark), "share"))


BAND_POINTS = (4, 7, 9, 9, 7, 4)  # cells of about equal area
BANDS = f"bp AS (SELECT b, n, p AS idx, 360.0 * p / n AS lo, 360.0 * (p + 1) / n AS hi FROM (SELECT unnest(range(0, {len(BAND_POINTS)})) AS b, unnest({list(BAND_POINTS)}) AS n), range(0, 9) r(p) WHERE p < n)"
TO_BANDS = f"""{CELLS}, {OLD_LON}, {OLD_LAT}, {NEW_LAT}, {BANDS}, {sql_overlap('wa', 'oa', 'na')},
la AS (SELECT wa.dst AS b, lon, sum(w * value) AS value FROM c JOIN wa ON c.lat = wa.src GROUP BY 1, 2),
bw AS (SELECT b, o.idx AS lon, p.idx AS point, n, (least(o.hi, p.hi) - greatest(o.lo, p.lo)) AS part FROM ol o JOIN bp p ON o.lo < p.hi AND p.lo < o.hi),
ea AS (SELECT b, point, sum(part * n / 360 * value) AS value FROM la JOIN bw USING (b, lon) GROUP BY 1, 2)"""


def _bands(spark, sf) -> DataFrame:
    lon = regrid.axis_cells(spark, [30.0 * i for i in range(13)])
    by_band = regrid.bands_weights({b: regrid.overlap_weights(lon, regrid.axis_cells(spark, [360.0 * i / n for i in range(n + 1)])) for b, n in enumerate(BAND_POINTS)})
    return regrid.to_equal_area(_cells(spark, sf).select("lat", "lon", "value"), _grid_weights(spark)["lat"], by_band)


@query(f"WITH {TO_BANDS} SELECT CAST(b AS INTEGER) AS band, CAST(point AS INTEGER) AS point, round(value, 4) AS value FROM ea")
def r_to_equal_area(spark, sf):
    return rounded(_bands(spark, sf))


@query(f"""WITH {TO_BANDS}, lo AS (SELECT b, lon, sum(part / 30 * value) AS value FROM ea JOIN bw USING (b, point) GROUP BY 1, 2), {sql_overlap('wb', 'na', 'oa')}
SELECT CAST(dst AS INTEGER) AS lat, CAST(lon AS INTEGER) AS lon, round(sum(w * value), 4) AS value FROM lo JOIN wb ON b = wb.src GROUP BY 1, 2""")
def r_from_equal_area(spark, sf):
    lon = regrid.axis_cells(spark, [30.0 * i for i in range(13)])
    back = regrid.bands_weights({b: regrid.overlap_weights(regrid.axis_cells(spark, [360.0 * i / n for i in range(n + 1)]), lon) for b, n in enumerate(BAND_POINTS)})
    lat = [regrid.axis_cells(spark, regrid.sine_limits([-90.0 + step * i for i in range(round(180 / step) + 1)])) for step in (30.0, 18.0)]
    return rounded(regrid.from_equal_area(_bands(spark, sf), regrid.overlap_weights(*lat), back))


# ---- models, months, chances ----


@query("""WITH e AS (SELECT event_type AS model, CAST(user_id % 50 AS BIGINT) AS site, CASE WHEN NOT (event_type = 'click' AND user_id % 50 = 3) THEN value END AS value FROM events),
n AS (SELECT DISTINCT model FROM (SELECT model, site FROM e GROUP BY 1, 2 HAVING count(value) = 0)) SELECT model, site, count(*) AS n FROM e WHERE model NOT IN (SELECT model FROM n) GROUP BY 1, 2""")
def p_usable_models(spark, sf):
    e = star.table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 50).cast("long").alias("site"), "value")
    e = e.withColumn("value", F.when(~((F.col("model") == "click") & (F.col("site") == 3)), F.col("value")))
    return panel.usable_models(e).groupBy("model", "site").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, l AS ({LINE}), x AS (SELECT l.site, {sql_t_cdf('((mu - 250000) / sigma)', 'nu')} AS p, obs.value > 250000 AS above FROM l JOIN obs ON obs.site = l.site AND obs.t = 27)
SELECT site, round(p, 6) AS p, above, round(-(CASE WHEN above THEN ln(p) ELSE ln(1 - p) END), 6) AS nll FROM x""")
def f_exceedance(spark, sf):
    obs = star.obs_panel(spark, sf)
    p = predict.predict("linear", obs, None, OPTIONS).join(obs.where(f"t = {T_PRED}").select("site", (F.col("value") > 250000).alias("above")), "site")
    p = p.withColumn("p", special.exceedance(F.col("mu"), F.col("sigma"), F.col("nu"), F.lit(250000.0)))
    return rounded(p.select("site", "p", "above", special.log_score(F.col("p"), F.col("above")).alias("nll")), 6)
