"""Queries over the supplied tables, one or more for each operator, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import special
from foretide.operators import panel, regrid
from foretide.plans import predict, verify
from foretide.sources import star

T_PRED = 27
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def logged(df: DataFrame, column: str) -> DataFrame:
    """The logarithm of a mean price: unlike the price it has no ties at a decimal, so both engines round it alike."""
    return rounded(df.withColumn(column, F.log(column)), 9)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- SQL pieces ----

OBS = """o_ AS (SELECT c_nationkey, o_orderdate, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
obs AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS t, avg(o_totalprice) AS value FROM o_ GROUP BY 1, 2),
obsm AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS t, avg(o_totalprice) AS value FROM o_ GROUP BY 1, 2),
h AS (SELECT * FROM obs WHERE t < 27)"""
FCST_TAIL = """fm AS (SELECT site, t, avg(value) AS m FROM fcst GROUP BY 1, 2),
j AS (SELECT h.site, h.t, h.value AS y, a.m - b.m AS m, w FROM h JOIN fm a USING (site, t) JOIN fm b ON b.site = h.site AND b.t = 27 JOIN w ON w.site = h.site),
c AS (SELECT *, t - avg(t) OVER s AS tc, m - avg(m) OVER s AS mc, y - avg(y) OVER s AS yc, y - m - avg(y - m) OVER s AS rc FROM j WINDOW s AS (PARTITION BY site))"""
FCST = f"""f_ AS (SELECT n_regionkey, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS t, o_orderpriority AS model, avg(o_totalprice) AS value FROM o_ JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
fcst AS (SELECT CAST(n_nationkey AS BIGINT) AS site, t, model, value FROM nation JOIN f_ USING (n_regionkey)),
w AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1),
{FCST_TAIL}"""

#: The same panels by supplier: as many sites as there are suppliers.
OBS_SUPPLIER = """o_ AS (SELECT CAST(l_suppkey AS BIGINT) AS site, CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS INTEGER) AS t, 'line' || least(l_linenumber, 5) AS model, l_extendedprice FROM lineitem),
obs AS (SELECT site, t, avg(l_extendedprice) AS value FROM o_ GROUP BY 1, 2),
h AS (SELECT * FROM obs WHERE t < 27)"""
FCST_SUPPLIER = f"""f_ AS (SELECT n_regionkey, t, model, avg(l_extendedprice) AS value FROM o_ JOIN supplier ON s_suppkey = o_.site JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
fcst AS (SELECT CAST(s_suppkey AS BIGINT) AS site, t, model, value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN f_ USING (n_regionkey)),
w AS (SELECT site, CAST(count(*) AS DOUBLE) AS w FROM o_ GROUP BY 1),
{FCST_TAIL}"""


def unrounded(sql: str) -> str:
    """A method's SQL with all decimals of its results."""
    return re.sub(r"round\(((?:(?!round\().)*?), [04]\) AS (mu|sigma|nu)", r"(\1) AS \2", sql, flags=re.S)


def sql_by_supplier(sql: str, huge: bool) -> str:
    """A method's SQL over the panels by supplier, less rounded, as there are more numbers to agree."""
    inner = unrounded(sql).replace(OBS, OBS_SUPPLIER).replace(FCST, FCST_SUPPLIER)
    return f"SELECT site, round(mu, 2) AS mu, round(sigma, {-4 if huge else 2}) AS sigma, round(nu, 2) AS nu FROM ({inner})"


def sql_moments(source: str, value: str, shift: str = "0", inflate: bool = False) -> str:
    grow = " * sqrt(1 + 1.0 / count(*))" if inflate else ""
    return f"SELECT site, round(avg({value}) + {shift}, 4) AS mu, round(stddev_samp({value}){grow}, 4) AS sigma, CAST(count(*) - 1 AS DOUBLE) AS nu FROM {source} GROUP BY site"


def sql_line(source: str, y: str, x: str, at: str) -> str:
    return f"""SELECT site, round(regr_intercept({y}, {x}) + regr_slope({y}, {x}) * {at}, 4) AS mu,
    round(sqrt((regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x})) / (count(*) - 2) * (1 + 1.0 / count(*) + pow({at} - avg({x}), 2) / regr_sxx({y}, {x}))), 4) AS sigma,
    CAST(count(*) - 2 AS DOUBLE) AS nu FROM {source} GROUP BY site"""


def _plain(sql: str) -> str:
    """The same SQL without rounding."""
    return sql.replace("round(", "(").replace(", 4)", ")")


def sql_t_cdf(x: str, nu: str) -> str:
    angle = f"atan(abs({x}) / sqrt({nu}))"
    simpson = f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(cos({angle} * i / 400), {nu} - 1))) * {angle} / 1200"
    return f"(0.5 + sign({x}) * ({simpson}) / exp(lgamma({nu} / 2) + lgamma(0.5) - lgamma({nu} / 2 + 0.5)))"


def sql_ln_beta(a: str, b: str) -> str:
    return f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"


def sql_digamma(x: str) -> str:
    z = f"({x} + 8)"
    back = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln({z}) - 0.5 / {z} - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - ({back}))"


def sql_logpdf(x: str, nu: str) -> str:
    return f"(-({nu} + 1) / 2 * ln(1 + {x} * {x} / {nu}) - ln({nu}) / 2 - {sql_ln_beta(f'{nu} / 2', '0.5')})"


def sql_entropy(nu: str) -> str:
    return f"(({nu} - 1) / 2 * ({sql_digamma(f'(({nu} + 1) / 2)')} - {sql_digamma(f'({nu} / 2)')}) + ln({nu}) / 2 + {sql_ln_beta(f'{nu} / 2', '0.5')})"


def sql_crps(x: str, nu: str) -> str:
    return f"(2 * exp({sql_logpdf(x, nu)}) * ({nu} + {x} * {x}) / ({nu} - 1) + {x} * (2 * {sql_t_cdf(x, nu)} - 1) - 2 * sqrt({nu}) / ({nu} - 1) * exp({sql_ln_beta('0.5', f'{nu} - 0.5')} - 2 * {sql_ln_beta('0.5', f'{nu} / 2')}))"


# ---- the prediction methods ----

METHOD_SQL = {
    "history": f"WITH {OBS} {sql_moments('h', 'value')}",
    "linear": f"WITH {OBS} {sql_line('h', 'value', 't', '27')}",
    "ma": f"WITH {OBS} {sql_moments('(SELECT * FROM h WHERE 27 - t <= 12)', 'value')}",
    "rawmodel": f"WITH {OBS}, {FCST} {sql_moments('j', 'y - m', inflate=True)}",
    "rawmodel_scaled": f"WITH {OBS}, {FCST} {sql_line('j', 'y', 'm', '0')}",
    "rawmodel_linear": f"WITH {OBS}, {FCST} {sql_line('j', '(y - m)', 't', '27')}",
    "rawmodel_globlinear": f"WITH {OBS}, {FCST}, b AS (SELECT sum(w * w * tc * rc) / sum(w * w * tc * tc) AS b FROM c) {sql_moments('(SELECT j.*, b FROM j, b)', 'y - m - b * t', 'any_value(b) * 27', True)}",
    "rawmodel_globscaled": f"WITH {OBS}, {FCST}, b AS (SELECT sum(w * w * mc * yc) / sum(w * w * mc * mc) AS b FROM c) {sql_moments('(SELECT j.*, b FROM j, b)', 'y - b * m', inflate=True)}",
    "rawmodel_globscaled_globlinear": f"""WITH {OBS}, {FCST}, s AS (SELECT sum(w * w * mc * mc) AS mm, sum(w * w * mc * tc) AS mt, sum(w * w * tc * tc) AS tt, sum(w * w * mc * yc) AS my, sum(w * w * tc * yc) AS ty FROM c),
        b AS (SELECT (my * tt - ty * mt) / (mm * tt - mt * mt) AS b1, (ty * mm - my * mt) / (mm * tt - mt * mt) AS b2 FROM s) {sql_moments('(SELECT j.*, b1, b2 FROM j, b)', 'y - b1 * m - b2 * t', 'any_value(b2) * 27', True)}""",
    "rawmodel_globcorr": f"WITH {OBS}, {FCST}, g AS (SELECT t, sum(w * (y - m)) / sum(w) AS g FROM j GROUP BY t), b AS (SELECT regr_slope(g, t) AS b FROM g) {sql_moments('(SELECT j.*, b FROM j, b)', 'y - m - b * t', 'any_value(b) * 27', True)}",
}
OPTIONS = predict.Options(t_pred=T_PRED, timescale=12.0)
#: Each method's first name.
METHODS = list({f: n for n, f in reversed(predict.REGISTRY.items())}.values())[::-1]
#: Their scales are near 1e9, where more decimals would be those of the last bits of a sum.
HUGE = ("rawmodel_pooled", "rawmodel_linear_pooled", "rawmultimodel_pooled")


def _method(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fcst = star.fcst_panel(spark, sf_dir)
        out = predict.predict(name, star.obs_panel(spark, sf_dir), fcst, OPTIONS, star.site_weights(spark, sf_dir))
        return rounded(out.withColumn("sigma", F.round("sigma", 0)) if name in HUGE else out)

    return run


def _method_by_supplier(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fcst = star.supplier_fcst(spark, sf_dir)
        out = predict.predict(name, star.supplier_obs(spark, sf_dir), fcst, OPTIONS, star.supplier_weights(spark, sf_dir))
        return rounded(out.withColumn("sigma", F.round("sigma", -4)) if name in HUGE else out, 2)

    return run


def add_method(name: str, sql: str | None) -> None:
    """The queries of a method by nation and by supplier."""
    query(sql, f"m_{name}")(_method(name))
    query(sql and sql_by_supplier(sql, name in HUGE), f"ms_{name}")(_method_by_supplier(name))


for _name in METHODS:
    add_method(_name, METHOD_SQL.get(_name))


# ---- time, quality, filling ----


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days FROM orders")
def p_days_per_month(spark, sf):
    d = star.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return d.withColumn("days", panel.days_per_month(F.col("year"), F.col("month")))


@query("WITH d AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders) SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(year(d - INTERVAL 14 MONTH) AS INTEGER) AS init_year, CAST(month(d - INTERVAL 14 MONTH) AS INTEGER) AS init_month FROM d")
def p_init_time(spark, sf):
    d = star.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    y, m = panel.shift_month(F.col("year"), F.col("month"), -14)
    return d.withColumn("init_year", y).withColumn("init_month", m)


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, m AS month FROM orders, (SELECT unnest([3, 4, 5]) AS m)")
def p_expand_months(spark, sf):
    return panel.months_of(star.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")), [3, 4, 5])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_quantity <= 40 AND l_quantity <> 7 THEN l_quantity END AS value FROM lineitem")
def p_quality(spark, sf):
    d = star.table(spark, sf, "lineitem")
    raw = F.when(d.l_quantity > 40, 1e21).when(d.l_quantity == 7, 0.0).otherwise(d.l_quantity)
    return d.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), panel.clean_forecast(raw, True).alias("value"))


@query(f"WITH {OBS} SELECT site, t, round(ln(value), 9) AS value FROM obsm WHERE site IN (SELECT site FROM obsm WHERE t <= 79 GROUP BY 1 HAVING count(*) = 79) AND t <= 79")
def p_complete_sites(spark, sf):
    return logged(panel.complete_sites(star.obs_panel(spark, sf, True).where("t <= 79"), 79), "value")


@query("SELECT event_type AS model, CAST(user_id % 7 AS BIGINT) AS grp, round(avg(value), 6) AS vals_mean, round(stddev_samp(value), 6) AS vals_sd, count(value) AS nr FROM events GROUP BY 1, 2")
def a_ensemble_summary(spark, sf):
    e = star.table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 7).cast("long").alias("grp"), "value")
    return rounded(panel.ensemble_summary(e, ["model", "grp"]), 6)


# offsets year by year, each gap with the models that are there beside it
GAPPY = """g AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS t, o_orderpriority AS model, avg(o_totalprice) AS value, stddev_samp(o_totalprice) AS sd FROM o_ GROUP BY 1, 2, 3),
gm AS (SELECT site, t, avg(value) AS mean, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT DISTINCT model FROM g), rms AS (SELECT site, model, sqrt(avg(sd * sd)) AS rms FROM g GROUP BY 1, 2),
whole AS (SELECT site, t FROM gm WHERE n = (SELECT count(*) FROM k)),
gap AS (SELECT gm.site, gm.t, k.model FROM gm CROSS JOIN k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.site = gm.site AND g.t = gm.t AND g.model = k.model)),
beside AS (SELECT gap.site, gap.t, gap.model, b.t AS year, avg(b.value) AS mean FROM gap JOIN g a ON a.site = gap.site AND a.t = gap.t JOIN g b ON b.site = gap.site AND b.model = a.model GROUP BY ALL),
adj AS (SELECT o.site, o.t, o.model, avg(f.value - o.mean) AS adj FROM beside o JOIN whole y ON y.site = o.site AND y.t = o.year JOIN g f ON f.site = o.site AND f.t = o.year AND f.model = o.model GROUP BY ALL),
filled AS (SELECT gm.site, gm.t, k.model, coalesce(g.value, gm.mean + adj) AS value, CASE WHEN g.value IS NULL THEN rms ELSE g.sd END AS sd, g.value IS NULL AS filled
  FROM gm CROSS JOIN k LEFT JOIN g ON g.site = gm.site AND g.t = gm.t AND g.model = k.model LEFT JOIN adj ON adj.site = gm.site AND adj.t = gm.t AND adj.model = k.model LEFT JOIN rms ON rms.site = gm.site AND rms.model = k.model)"""


@query(f"WITH {OBS}, {GAPPY} SELECT site, t, model, round(ln(value), 9) AS value, filled FROM filled")
def b_fill_missing_years(spark, sf):
    return logged(panel.fill_missing_years(star.fcst_gappy(spark, sf)), "value")


@query(f"WITH {OBS}, d AS (SELECT site, CAST(1995 + (t - 1) // 12 AS INTEGER) AS year, (t - 1) % 12 + 1 AS month, value, day(last_day(make_date(1995 + (t - 1) // 12, (t - 1) % 12 + 1, 1))) AS days FROM obsm) SELECT site, year, round(sum(days * value) / sum(days), 4) AS value FROM d WHERE month IN (3, 4, 5) GROUP BY 1, 2 HAVING count(*) = 3")
def a_season_mean(spark, sf):
    d = star.obs_panel(spark, sf, True).select("site", (1995 + F.floor((F.col("t") - 1) / 12)).cast("int").alias("year"), ((F.col("t") - 1) % 12 + 1).alias("month"), "value")
    return rounded(panel.season_mean(d, ["site"], [3, 4, 5]))


@query(f"WITH {OBS}, g AS (SELECT s.site, t.t, o.value FROM (SELECT DISTINCT site FROM obsm) s CROSS JOIN (SELECT DISTINCT t FROM obsm) t LEFT JOIN obsm o ON o.site = s.site AND o.t = t.t AND (s.site + t.t) % 5 > 1) SELECT site, t, round(ln(coalesce(value, (SELECT v.value FROM g v WHERE v.site = g.site AND v.value IS NOT NULL ORDER BY abs(v.t - g.t), v.t LIMIT 1))), 9) AS filled FROM g")
def w_nearest_fill(spark, sf):
    o = star.obs_panel(spark, sf, True)
    grid = o.select("site").distinct().crossJoin(F.broadcast(o.select("t").distinct()))  # a bounded number of months
    d = grid.join(o, ["site", "t"], "left").withColumn("value", F.when((F.col("site") + F.col("t")) % 5 > 1, F.col("value")))
    return logged(panel.fill_from_neighbours(d, ["site"], "t").drop("value"), "filled")


@query(f"WITH {OBS} SELECT site, t, round(value - avg(value) OVER (PARTITION BY site, t % 12), 4) AS anomaly FROM obsm")
def p_deseasonalise(spark, sf):
    return rounded(panel.anomalies(star.obs_panel(spark, sf, True), ["site"], F.col("t") % 12).drop("value"))


@query(f"WITH {OBS} SELECT site, t, round(value - avg(value) OVER s - regr_slope(value, t) OVER s * (t - avg(t) OVER s), 4) AS detrended FROM obs WINDOW s AS (PARTITION BY site)")
def p_detrend(spark, sf):
    return rounded(panel.detrended(star.obs_panel(spark, sf), ["site"]).drop("value"))


@query(f"WITH {OBS} SELECT site, t, round(ln(avg(value) OVER (PARTITION BY site ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), 9) AS smooth FROM obsm")
def w_trailing_mean(spark, sf):
    return logged(panel.trailing_mean(star.obs_panel(spark, sf, True), ["site"], 12).drop("value"), "smooth")


ZERO = f"""WITH e AS (SELECT event_type AS site, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INTEGER) AS t, avg(value) - 100 AS value FROM events GROUP BY 1, 2),
k AS (SELECT *, value - avg(value) OVER (PARTITION BY site) AS k FROM e), l AS (SELECT *, k * lead(k) OVER (PARTITION BY site ORDER BY t) AS kk FROM k),
g AS (SELECT site, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, sum(kk) / (count(*) - 1) / var_samp(value) AS r FROM l GROUP BY 1),
z AS (SELECT site, n, mean, sd, n * (1 - r) / (1 + r) AS n_adj FROM g), y AS (SELECT *, sqrt(n_adj) * mean / sd AS t FROM z)
SELECT site, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(n_adj, 6) AS n_adj, round(t, 6) AS t, round(2 * {sql_t_cdf('(-abs(t))', '(n_adj - 1)')}, 6) AS p FROM y"""


@query(ZERO)
def f_p_zero(spark, sf):
    e = star.table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.datediff("ts", F.lit("2024-01-01")).alias("t")).agg((F.avg("value") - 100).alias("value"))
    d = panel.zero_mean_test(e, ["site"])
    return rounded(d.withColumn("p", 2 * special.t_cdf(-F.abs("t"), F.col("n_adj") - 1)), 6)


@query(f"WITH {OBS}, r AS (SELECT site, t, value, max(value) OVER s AS level, count(value) OVER s AS n FROM obsm WINDOW s AS (PARTITION BY site, t % 12 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT site, t, round(ln(level), 9) AS level, coalesce(value > level, false) AS is_record, round(1.0 / (n + 1), 9) AS p_stationary FROM r")
def v_records(spark, sf):
    d = star.obs_panel(spark, sf, True).withColumn("season", F.col("t") % 12)
    return logged(panel.records(d, ["site", "season"]).select("site", "t", "level", F.coalesce("is_record", F.lit(False)).alias("is_record"), "p_stationary"), "level")


@query(f"WITH {OBS} SELECT site, t, rank() OVER (PARTITION BY site ORDER BY value) + (count(*) OVER (PARTITION BY site, value) - 1) / 2 AS avg_rank FROM obs")
def w_ranks(spark, sf):
    return panel.average_ranks(star.obs_panel(spark, sf), ["site"]).drop("value")


@query()
def b_normal_scores(spark, sf):
    return rounded(panel.normal_scores(star.obs_panel(spark, sf).where(f"t < {T_PRED}"), ["site"]), 6)


@query()
def b_transform_scores(spark, sf):
    o = star.obs_panel(spark, sf)
    return rounded(panel.transform_scores(o.where(f"t >= {T_PRED - 1}"), o.where(f"t < {T_PRED - 1}"), ["site"]), 6)


HAZEN = "(SELECT site, list_sort(list(value)) AS s, len(list(value)) AS n FROM h GROUP BY 1)"


def sql_hazen(q: str) -> str:
    at = f"greatest(1.0, least(n, {q} * n + 0.5))"
    return f"(s[CAST(floor({at}) AS INTEGER)] + ({at} - floor({at})) * (s[CAST(least(floor({at}) + 1, n) AS INTEGER)] - s[CAST(floor({at}) AS INTEGER)]))"


@query(f"WITH {OBS} SELECT site, round({sql_hazen('0.3')}, 4) AS quantile FROM {HAZEN}")
def a_quantile(spark, sf):
    return rounded(panel.quantile(star.obs_panel(spark, sf).where(f"t < {T_PRED}"), ["site"], 0.3))


# ---- regridding ----


@query("""WITH u AS (SELECT CAST(l_quantity AS INTEGER) - 1 AS q, avg(l_extendedprice) AS u FROM lineitem GROUP BY 1),
o AS (SELECT q, u, (q + 1) - 0.5 AS lo, (q + 1) + 0.5 AS hi FROM u), n AS (SELECT i, 7.5 * i AS lo, 7.5 * (i + 1) AS hi FROM range(0, 7) r(i))
SELECT CAST(i AS INTEGER) AS q, round(sum(u * (least(o.hi, n.hi) - greatest(o.lo, n.lo))) / sum(least(o.hi, n.hi) - greatest(o.lo, n.lo)), 4) AS value FROM o JOIN n ON o.lo < n.hi AND n.lo < o.hi GROUP BY 1""")
def r_regrid_1d(spark, sf):
    u = star.table(spark, sf, "lineitem").groupBy((F.col("l_quantity").cast("int") - 1).alias("q")).agg(F.avg("l_extendedprice").alias("value"))
    w = regrid.overlap_weights(regrid.axis_cells(spark, [0.5 + i for i in range(51)]), regrid.axis_cells(spark, [7.5 * i for i in range(8)]))
    return rounded(regrid.regrid(u, {"q": w}))


@query("""WITH u AS (SELECT CAST(l_quantity AS INTEGER) - 1 AS q, CAST(p_size AS INTEGER) - 1 AS z, avg(l_extendedprice) AS u FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT q // 10 AS q, z // 25 AS z, u FROM u) SELECT CAST(q AS INTEGER) AS q, CAST(z AS INTEGER) AS z, round(avg(u), 4) AS value FROM p GROUP BY 1, 2""")
def r_regrid_2d(spark, sf):
    parts = star.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size").cast("int") - 1).alias("z"))
    u = star.table(spark, sf, "lineitem").join(parts, "l_partkey").groupBy((F.col("l_quantity").cast("int") - 1).alias("q"), "z").agg(F.avg("l_extendedprice").alias("value"))
    old = regrid.axis_cells(spark, [float(i) for i in range(51)])
    weights = {"q": regrid.overlap_weights(old, regrid.axis_cells(spark, [10.0 * i for i in range(6)])), "z": regrid.overlap_weights(old, regrid.axis_cells(spark, [0.0, 25.0, 50.0]))}
    return rounded(regrid.regrid(u, weights, least_valid=0.0))


# ---- verification ----


def _predictions(spark, sf, times=range(20, 28), name="linear") -> DataFrame:
    """Predictions of several target times from the history before each."""
    return predict.predict_targets(name, star.obs_panel(spark, sf), list(times))


def _scored(spark, sf) -> DataFrame:
    return verify.scored(_predictions(spark, sf), star.obs_panel(spark, sf), ["site", "t"], star.site_weights(spark, sf))


PRED = f"""{OBS}, tt AS (SELECT CAST(i AS INTEGER) AS tp FROM range(20, 28) r(i)),
pr AS (SELECT site, tp AS t, count(*) - 2.0 AS nu, regr_intercept(value, t) + regr_slope(value, t) * tp AS mu,
  sqrt((regr_syy(value, t) - regr_slope(value, t) * regr_sxy(value, t)) / (count(*) - 2) * (1 + 1.0 / count(*) + pow(tp - avg(t), 2) / regr_sxx(value, t))) AS sigma
  FROM obs JOIN tt ON obs.t < tp GROUP BY site, tp),
wt AS (SELECT CAST(c_nationkey AS BIGINT) AS site, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY 1),
s AS (SELECT pr.*, obs.value AS y, w, (obs.value - mu) / sigma AS z, mu - obs.value AS error FROM pr JOIN obs USING (site, t) JOIN wt USING (site)),
sc AS (SELECT *, -{sql_logpdf('z', 'nu')} + ln(sigma) AS nll, sigma * {sql_crps('z', 'nu')} AS crps, {sql_entropy('nu')} + ln(sigma) AS predent, {sql_t_cdf('z', 'nu')} AS pit FROM s)"""
SUMMARY = "round(sqrt(sum(w * error * error) / sum(w)), 4) AS rmse, round(sum(w * error) / sum(w), 4) AS bias, round(sum(w * nll) / sum(w), 4) AS nll, round(sum(w * crps) / sum(w), 4) AS crps, round(sum(w * predent) / sum(w), 4) AS predent"


@query(f"WITH {PRED} SELECT {SUMMARY} FROM sc")
def v_scores(spark, sf):
    return rounded(verify.summary(_scored(spark, sf), []))


@query(f"WITH {PRED} SELECT t, {SUMMARY} FROM sc GROUP BY t")
def v_scores_by_time(spark, sf):
    return rounded(verify.summary(_scored(spark, sf), ["t"]))


@query(f"WITH {PRED}, sd AS (SELECT * REPLACE (1.0 AS w) FROM sc) SELECT site, {SUMMARY} FROM sd GROUP BY site")
def v_scores_by_site(spark, sf):
    return rounded(verify.summary(_scored(spark, sf), ["site"], weighted=False))


@query(f"WITH {PRED} SELECT CAST(greatest(1, least(20, ceil(20 * pit))) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY 1")
def v_pit_histogram(spark, sf):
    return verify.pit_histogram(_scored(spark, sf), [], 20)


@query(f"WITH {PRED}, r AS (SELECT pit, row_number() OVER (ORDER BY pit) AS i, count(*) OVER () AS n FROM sc) SELECT round(ks, 6) AS ks, n, round(least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 21), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * n * ks * ks))))), 6) AS kp FROM (SELECT max(greatest(1.0 * i / n - pit, pit - 1.0 * (i - 1) / n)) AS ks, any_value(n) AS n FROM r)")
def v_ks(spark, sf):
    return rounded(verify.ks_statistic(_scored(spark, sf), []), 6)


@query()
def v_calibration(spark, sf):
    a, b = verify.calibrate(_scored(spark, sf))
    return rounded(spark.createDataFrame([(a, b)], "log_sigma_factor double, log_nu_factor double"), 3)


TERCILES = f"""WITH {OBS}, q AS (SELECT site, {sql_hazen('(1.0 / 3)')} AS lower, {sql_hazen('(2.0 / 3)')} AS upper FROM {HAZEN}), p AS ({sql_line('h', 'value', 't', '27').replace('round(', '(').replace(', 4)', ')')}),
b AS (SELECT site, {sql_t_cdf('((lower - mu) / sigma)', 'nu')} AS below, 1 - {sql_t_cdf('((upper - mu) / sigma)', 'nu')} AS above FROM p JOIN q USING (site))
SELECT site, round(below, 6) AS below, round(above, 6) AS above, CAST(CASE WHEN below > above THEN -len(list_filter(range(1, 7), lambda k: below > 0.3 + k / 10)) WHEN above > below THEN len(list_filter(range(1, 7), lambda k: above > 0.3 + k / 10)) ELSE 0 END AS INTEGER) AS tercile FROM b"""


@query(TERCILES)
def v_tercile_map(spark, sf):
    obs = star.obs_panel(spark, sf)
    past = obs.where(f"t < {T_PRED}")
    q = panel.quantile(past, ["site"], 1 / 3).withColumnRenamed("quantile", "lower").join(panel.quantile(past, ["site"], 2 / 3).withColumnRenamed("quantile", "upper"), "site")
    return rounded(verify.tercile_map(predict.predict("linear", obs, None, OPTIONS), q), 6)


@query(f"WITH {OBS}, p AS ({sql_line('h', 'value', 't', '27').replace('round(', '(').replace(', 4)', ')')}), v AS (SELECT unnest([200000.0, 250000.0]) AS value) SELECT site, CAST(value AS DOUBLE) AS value, round({sql_t_cdf('((value - mu) / sigma)', 'nu')}, 6) AS p, round(sigma * sqrt(nu / (nu - 2)), 4) AS sd FROM p, v")
def v_values_cdf(spark, sf):
    p = verify.values_cdf(predict.predict("linear", star.obs_panel(spark, sf), None, OPTIONS), [200000.0, 250000.0])
    return p.select("site", "value", F.round("p", 6).alias("p"), F.round(special.predictive_sd(F.col("sigma"), F.col("nu")), 4).alias("sd"))
