"""SQL of the prediction methods that need linear systems: normal equations solved inside the database.

A matrix is a list of rows. A recursive query eliminates one column a step, so that what stands right of the square part
is left multiplied by its inverse. Every matrix here is symmetric and positive definite, so no rows need to be swapped.
The panel may not have gaps: every site and model has every quarter, as at scale factors from 0.01.
"""

from __future__ import annotations

import re

from foretide.queries import FCST, HUGE, METHOD_SQL, OBS, OPTIONS, SQL, _plain, sql_by_supplier, sql_entropy, sql_line, sql_logpdf, sql_moments

MODELS = 5  # order priorities
LINES = [f"x{i}" for i in range(1, MODELS + 1)]


def solved(name: str, source: str, logdet: bool = False) -> str:
    """CTE `name`: the rows of source, its matrix `a` reduced, and if asked the logarithm of its square part's determinant."""
    other = "list_transform(range(1, len(a[1]) + 1), lambda j: a[i][j] - a[i][k] * a[k][j] / a[k][k])"
    step = f"list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = k THEN list_transform(a[k], lambda v: v / a[k][k]) ELSE {other} END)"
    first, more = (", 0.0::DOUBLE AS logdet", ", logdet + ln(a[k][k]) AS logdet") if logdet else ("", "")
    return f"""{name}_g AS (SELECT *, 1 AS k{first} FROM {source} UNION ALL SELECT * REPLACE ({step} AS a, k + 1 AS k{more}) FROM {name}_g WHERE k <= len(a)),
{name} AS (SELECT * EXCLUDE (k) FROM {name}_g WHERE k = len(a) + 1)"""


def column(c: str | int, of: str = "a") -> str:
    return f"list_transform({of}, lambda r: r[{c}])"


def combined(parts: str, factors: str, n: str) -> str:
    """The sum of columns times factors, row by row."""
    return f"list_transform(range(1, {n} + 1), lambda i: list_dot_product({factors}, list_transform({parts}, lambda c: c[i])))"


def minus(a: str, b: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - {b}[i])"


# histories as lists, forecasts by model relative to the target, all by time
SERIES = """n_ AS (SELECT count(DISTINCT t) AS n FROM h),
hs AS (SELECT site, list(value ORDER BY t) AS y, list(CAST(27 - t AS DOUBLE) ORDER BY t) AS v, list(1.0::DOUBLE ORDER BY t) AS one FROM h GROUP BY site HAVING count(*) = (SELECT n FROM n_))"""
XS = ", ".join(f"a.x[{i}] - b.x[{i}] AS x{i}" for i in range(1, MODELS + 1))
WIDE = f"""fx AS (SELECT site, t, list(value ORDER BY model) AS x FROM fcst GROUP BY 1, 2),
jx AS (SELECT h.site, h.t, h.value AS y, 1.0::DOUBLE AS one, CAST(h.t AS DOUBLE) AS tt, CAST(27 - h.t AS DOUBLE) AS v, {XS}, w FROM h JOIN fx a USING (site, t) JOIN fx b ON b.site = h.site AND b.t = 27 JOIN w ON w.site = h.site)"""


def listed(columns: list[str], source: str, more: str = "") -> str:
    """By site: y, the columns of the design, and the row where it is predicted (the first column alone)."""
    cols = ", ".join(f"list({c} ORDER BY t)" for c in columns)
    at = ", ".join("1.0::DOUBLE" if i == 0 else "0.0::DOUBLE" for i in range(len(columns)))
    return f"(SELECT site, list(y ORDER BY t) AS y, [{cols}] AS cols, [{at}] AS goal{more} FROM {source} GROUP BY site)"


def least_squares(source: str, penalty: str = "0.0", prior: str = "0.0", rows_more: int = 0) -> str:
    """Rows site, mu, sigma, nu. penalty and prior, of coefficient i, stand for one more row of the design each."""
    cell = f"list_dot_product(cols[i], cols[j]) + CASE WHEN i = j THEN {penalty} ELSE 0.0 END"
    a = f"list_transform(range(1, len(cols) + 1), lambda i: list_concat(list_transform(range(1, len(cols) + 1), lambda j: {cell}), [list_dot_product(cols[i], y) + {penalty} * {prior}, goal[i]]))"
    return f"""ne AS (SELECT *, {a} AS a FROM {source}), {solved('so', 'ne')},
be AS (SELECT *, {column('len(a) + 1')} AS beta, {column('len(a) + 2')} AS inner_, len(y) + {rows_more} - len(a) AS nu FROM so),
re AS (SELECT *, {combined('cols', 'beta', 'len(y)')} AS fit FROM be),
rs AS (SELECT *, list_sum(list_transform(range(1, len(y) + 1), lambda i: pow(y[i] - fit[i], 2))) + list_sum(list_transform(range(1, len(beta) + 1), lambda i: {penalty} * pow(beta[i] - {prior}, 2))) AS rss FROM re)
SELECT site, round(list_dot_product(goal, beta), 4) AS mu, round(sqrt(rss / nu * (1 + list_dot_product(goal, inner_))), 4) AS sigma, CAST(nu AS DOUBLE) AS nu FROM rs"""


def walk(source: str, lost: int) -> str:
    """Generalised least squares where white noise is mixed with a random walk that ends at the target."""
    g = repr(OPTIONS.gamma)
    cov = f"list_transform(range(1, n + 1), lambda i: list_concat(list_transform(range(1, n + 1), lambda j: {g} * least(v[i], v[j]) + CASE WHEN i = j THEN 1 - {g} ELSE 0.0 END), list_transform(range(1, n + 1), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END)))"
    times = "list_dot_product(r, {})"
    return f"""q0 AS (SELECT {cov} AS a FROM (SELECT list(v ORDER BY v DESC) AS v, count(*) AS n FROM (SELECT DISTINCT CAST(27 - t AS DOUBLE) AS v FROM h))), {solved('q1', 'q0')},
q AS (SELECT list_transform(a, lambda r: r[len(a) + 1 : 2 * len(a)]) AS q FROM q1),
d AS (SELECT s.*, list_transform(q, lambda r: {times.format('y')}) AS qy, list_transform(cols, lambda c: list_transform(q, lambda r: {times.format('c')})) AS qc FROM {source} s, q),
ne AS (SELECT *, list_transform(range(1, len(cols) + 1), lambda i: list_concat(list_transform(qc, lambda c: list_dot_product(cols[i], c)), [list_dot_product(cols[i], qy), goal[i]])) AS a FROM d), {solved('so', 'ne')},
be AS (SELECT *, {column('len(a) + 1')} AS beta, {column('len(a) + 2')} AS inner_ FROM so),
re AS (SELECT *, {minus('y', combined('cols', 'beta', 'len(y)'))} AS rest, {minus('qy', combined('qc', 'beta', 'len(y)'))} AS qrest FROM be)
SELECT site, round(beta[1], 4) AS mu, round(sqrt(list_dot_product(rest, qrest) / (len(y) - len(cols) + 1) * (1 - {g} + inner_[1])), 4) AS sigma, CAST(len(y) - {lost} AS DOUBLE) AS nu FROM re"""


def global_fit(source: str, y: str, xs: list[str]) -> str:
    """CTE gb: b, the coefficients of xs over all rows with squared weights."""
    rows = ", ".join("[" + ", ".join(f"sum(w * w * {a} * {b})" for b in [*xs, y]) + "]" for a in xs)
    return f"gn AS (SELECT [{rows}] AS a FROM {source}), {solved('gs', 'gn')}, gb AS (SELECT {column('len(a) + 1')} AS b FROM gs)"


def centred(source: str, columns: list[str]) -> str:
    return f"(SELECT *, {', '.join(f'{c} - avg({c}) OVER s AS {c}_c' for c in columns)} FROM {source} WINDOW s AS (PARTITION BY site))"


def global_models(trend: bool) -> str:
    xs = [*LINES, *(["tt"] if trend else [])]
    part = " - ".join(["y", *(f"b[{i}] * {x}" for i, x in enumerate(xs, 1))])
    return f"""WITH RECURSIVE {OBS}, {FCST}, {WIDE}, {global_fit(centred('jx', ['y', *xs]), 'y_c', [f'{x}_c' for x in xs])}
{sql_moments('(SELECT jx.*, b FROM jx, gb)', part, f'any_value(b)[{len(xs)}] * 27' if trend else '0', True)}"""


# ---- partial pooling ----


def pooled(xs: list[str], trend: bool = False) -> str:
    """Fits by site, a common mean and spread of each coefficient, and each site drawn to it with a penalty of one."""
    names = ["one", *(["tt"] if trend else []), *(f"{x}_c" for x in xs)]
    k = len(names)
    mean = f"list_sum(x) / {MODELS}"
    raw = [f"x[{i}] AS x{i}" for i in range(1, MODELS + 1)]
    at = ", ".join(["1.0::DOUBLE", *(["27.0::DOUBLE"] if trend else []), *(f"any_value(at_{x})" for x in xs)])
    cols = ", ".join(f"list({c} ORDER BY t)" for c in names)
    sums = ", ".join(f"sum(beta[{i}] / var[{i}]) / sum(1 / var[{i}])" for i in range(1, k + 1))
    spreads = ", ".join(f"sqrt(greatest(avg(pow(beta[{i}] - mean[{i}], 2) - var[{i}]), pow(2.0, -52)))" for i in range(1, k + 1))
    return f"""WITH RECURSIVE {OBS}, {FCST}, {WIDE},
pm AS (SELECT site, t, {mean} AS m, {', '.join(raw)} FROM fx WHERE t <= 27 AND (t = 27 OR (site, t) IN (SELECT (site, t) FROM h))),
pc AS (SELECT *, {', '.join(f'{x} - avg({x}) OVER s AS {x}_c' for x in xs)} FROM pm WINDOW s AS (PARTITION BY site)),
pj AS (SELECT h.site, h.t, h.value AS y, 1.0::DOUBLE AS one, CAST(h.t AS DOUBLE) AS tt, {', '.join(f'a.{x}_c, b.{x}_c AS at_{x}' for x in xs)} FROM h JOIN pc a USING (site, t) JOIN pc b ON b.site = h.site AND b.t = 27),
pd AS (SELECT site, list(y ORDER BY t) AS y, [{cols}] AS cols, [{at}] AS goal FROM pj GROUP BY site),
n1 AS (SELECT *, list_transform(range(1, {k} + 1), lambda i: list_concat(list_transform(cols, lambda c: list_dot_product(cols[i], c)), [list_dot_product(cols[i], y)], list_transform(range(1, {k} + 1), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END))) AS a FROM pd), {solved('s1', 'n1')},
b1 AS (SELECT *, {column(k + 1)} AS beta FROM s1),
v1 AS (SELECT *, list_sum(list_transform({minus('y', combined('cols', 'beta', 'len(y)'))}, lambda r: r * r)) / (len(y) - {k}) AS s2 FROM b1),
w1 AS (SELECT *, list_transform(range(1, {k} + 1), lambda i: s2 * a[i][{k} + 1 + i]) AS var FROM v1),
me AS (SELECT [{sums}] AS mean FROM w1), sp AS (SELECT [{spreads}] AS spread FROM (SELECT beta, var, mean FROM w1, me)),
e1 AS (SELECT site, sqrt(s2) AS f, mean, spread, cols, {minus('y', combined('cols', 'mean', 'len(y)'))} AS r, goal FROM w1, me, sp),
e2 AS (SELECT site, mean, spread, goal, list_transform(r, lambda u: u * f) AS r, list_transform(range(1, {k} + 1), lambda i: list_transform(cols[i], lambda u: u * spread[i] * f)) AS cols FROM e1),
e3 AS (SELECT *, list_transform(range(1, {k} + 1), lambda i: list_transform(cols, lambda c: list_dot_product(cols[i], c))) AS aa FROM e2),
n2 AS (SELECT *, list_transform(range(1, {k} + 1), lambda i: list_concat(list_transform(range(1, {k} + 1), lambda j: aa[i][j] + CASE WHEN i = j THEN 1.0 ELSE 0.0 END), [list_dot_product(cols[i], r), goal[i] * spread[i]], list_transform(range(1, {k} + 1), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END))) AS a FROM e3), {solved('s2', 'n2')},
z AS (SELECT *, {column(k + 1)} AS z, {column(k + 2)} AS u, len(r) - {k} + list_sum(list_transform(range(1, {k} + 1), lambda i: a[i][{k} + 2 + i])) AS nu FROM s2),
pz AS (SELECT *, list_sum(list_transform({minus('r', combined('cols', 'z', 'len(r)'))}, lambda e: e * e)) AS rss, list_dot_product(u, list_transform(aa, lambda c: list_dot_product(c, u))) AS lever FROM z)
SELECT site, round(list_dot_product(goal, mean) + list_sum(list_transform(range(1, {k} + 1), lambda i: goal[i] * spread[i] * z[i])), 4) AS mu, round(sqrt(rss / nu * (1 + lever)), 0) AS sigma, round(nu, 4) AS nu FROM pz"""


# ---- around a smoothing spline of evenly spaced times ----

P = OPTIONS.spline_p


def spline(name: str, source: str) -> str:
    """CTE `name`: the rows of source (with the list y) and trend, the spline there, and ahead, the spline one step beyond.

    Second derivatives c at inner points solve (R + f Q'Q) c = Q'y, and the spline is y - f Q c, f = (1 - p) / p.
    """
    f = f"((1 - {P!r}) / {P!r})"
    left = f"CASE abs(i - j) WHEN 0 THEN 2.0 / 3 + 6 * {f} WHEN 1 THEN 1.0 / 6 - 4 * {f} WHEN 2 THEN {f} ELSE 0.0 END"
    right = "CASE j - i WHEN 0 THEN 1.0 WHEN 1 THEN -2.0 WHEN 2 THEN 1.0 ELSE 0.0 END"
    return f"""{name}_0 AS (SELECT list_transform(range(1, n - 1), lambda i: list_concat(list_transform(range(1, n - 1), lambda j: CAST({left} AS DOUBLE)), list_transform(range(1, n + 1), lambda j: CAST({right} AS DOUBLE)))) AS a FROM (SELECT max(len(y)) AS n FROM {source})),
{solved(f'{name}_1', f'{name}_0')},
{name}_2 AS (SELECT s.*, list_concat([0.0, 0.0], list_transform(a, lambda r: list_dot_product(r[len(a) + 1 : 2 * len(a) + 2], y)), [0.0, 0.0]) AS c FROM {source} s, {name}_1 WHERE len(y) = len(a) + 2),
{name}_3 AS (SELECT *, list_transform(range(1, len(y) + 1), lambda i: y[i] - {f} * (c[i] - 2 * c[i + 1] + c[i + 2])) AS trend FROM {name}_2),
{name} AS (SELECT *, 2 * trend[len(y)] - trend[len(y) - 1] + c[len(y)] / 6 AS ahead FROM {name}_3)"""


TREND = f"""{spline('ot', 'hs')},
od AS (SELECT site, unnest({minus('y', 'trend')}) + ahead AS y, 27 - unnest(v) AS t FROM ot)"""
DETRENDED = f"""{TREND}, fl AS (SELECT site, model, list(value ORDER BY t) AS y, list(t ORDER BY t) AS ts FROM fcst WHERE t <= 27 GROUP BY 1, 2), {spline('ft', 'fl')},
fd AS (SELECT site, model, unnest({minus('y', 'trend')}) AS value, unnest(ts) AS t FROM ft),
dx AS (SELECT site, t, list(value ORDER BY model) AS x FROM fd GROUP BY 1, 2),
jd AS (SELECT od.site, od.t, od.y, 1.0::DOUBLE AS one, {XS}, list_sum(a.x) / {MODELS} - list_sum(b.x) / {MODELS} AS m, w FROM od JOIN dx a ON a.site = od.site AND a.t = od.t JOIN dx b ON b.site = od.site AND b.t = 27 JOIN w ON w.site = od.site)"""


def fewer(source: str, value: str, shift: str = "0.0") -> str:
    dof = OPTIONS.dof_spline
    return f"SELECT site, round(avg({value}) + {shift}, 4) AS mu, round(stddev_samp({value}) * sqrt((count(*) - 1) / (count(*) - {dof})), 4) AS sigma, CAST(count(*) - {dof} AS DOUBLE) AS nu FROM {source} GROUP BY site"


_models = f"{OBS}, {FCST}, {WIDE}"
_smooth = f"WITH RECURSIVE {OBS}, {FCST}, {SERIES}, {DETRENDED}"
_sum = " + ".join([*(f"b[{i}] * x{i}" for i in range(1, MODELS + 1)), f"b[{MODELS + 1}]"])
_raw = " + ".join([*(f"any_value(b)[{i}] * any_value(p)[{i}]" for i in range(1, MODELS + 1)), f"any_value(b)[{MODELS + 1}]"])
_joint = "(SELECT site, t, y, one, v, (x1 + x2 + x3 + x4 + x5) / 5 AS m FROM jx)"
_pieces = [_plain(METHOD_SQL[n]).removeprefix(f"WITH {OBS} ") for n in OPTIONS.of]
_penalty = f"(CASE WHEN i > 1 THEN {OPTIONS.lamda**2!r} ELSE 0.0 END)"

METHODS = {
    "ewma": f"WITH RECURSIVE {OBS}, {SERIES}, {walk('(SELECT site, y, [one] AS cols, [1.0::DOUBLE] AS goal FROM hs)', 1)}",
    "ewma_linear": f"WITH RECURSIVE {OBS}, {SERIES}, {walk('(SELECT site, y, [one, v] AS cols, [1.0::DOUBLE, 0.0] AS goal FROM hs)', 2)}",
    "ewma_model": f"WITH RECURSIVE {_models}, {walk(listed(['one', 'm'], _joint), 3)}",
    "ewma_linear_model": f"WITH RECURSIVE {_models}, {walk(listed(['one', 'v', 'm'], _joint), 4)}",
    "rawmultimodel": f"WITH RECURSIVE {_models}, {least_squares(listed(['one', *LINES], 'jx'))}",
    "rawmultimodel_glob": global_models(False),
    "rawmultimodel_glob_globlinear": global_models(True),
    "rawmodel_pooled": pooled(["m"]),
    "rawmodel_linear_pooled": pooled(["m"], True),
    "rawmultimodel_pooled": pooled(LINES),
    "trend": f"WITH RECURSIVE {OBS}, {SERIES}, {TREND} {fewer('od', 'y')}",
    "model_trend": f"{_smooth}, {least_squares(listed(['one', 'm'], 'jd'))}",
    "multimodel_trend": f"{_smooth}, {least_squares(listed(['one', *LINES], 'jd'))}",
    "globalmultimodel_trend": f"{_smooth}, {global_fit('jd', 'y', [*LINES, 'one'])}, fp AS (SELECT site, list(value ORDER BY model) AS p FROM fcst WHERE t = 27 GROUP BY 1) {fewer('(SELECT jd.*, b, p FROM jd JOIN fp USING (site), gb)', f'y - ({_sum})', _raw)}",
    "regmultimodel_trend": f"{_smooth}, {global_fit('jd', 'y', [*LINES, 'one'])}, {least_squares(listed(['one', *LINES], '(SELECT jd.*, b FROM jd, gb)', ', any_value(b) AS b'), _penalty, '(CASE WHEN i > 1 THEN b[i - 1] ELSE 0.0 END)', MODELS)}",
    "multimethod": f"WITH {OBS}, u AS ({' UNION ALL '.join(f'SELECT *, {n} AS place FROM ({p})' for n, p in enumerate(_pieces))}), e AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {sql_entropy('nu')} + ln(sigma), place) AS r FROM u) SELECT site, round(mu, 4) AS mu, round(sigma, 4) AS sigma, nu FROM e WHERE r = 1",
}
SQL |= {f"m_{n}": s for n, s in METHODS.items()} | {f"ms_{n}": sql_by_supplier(s, n in HUGE) for n, s in METHODS.items()}


# ---- many targets and leads: a site stands for one site, target and lead ----

TARGETS, LEADS = range(20, 28), (1, 2)
EACH = "((lag * 100 + tp) * 1000 + site)"
TARGET_PANEL = f"""{OBS}, {FCST}, tt AS (SELECT CAST(i AS INTEGER) AS tp, unnest({list(LEADS)}) AS lag FROM range({TARGETS.start}, {TARGETS.stop}) r(i)),
fl AS (SELECT site, t + lag - 1 AS t, lag, list(value ORDER BY model) AS x FROM fcst, (SELECT unnest({list(LEADS)}) AS lag) GROUP BY ALL),
hh AS (SELECT {EACH} AS site, lag * 100 + tp AS grp, tp, o.t, o.value AS y, 1.0::DOUBLE AS one, (o.t - tp) / 10.0 AS u, pow((o.t - tp) / 10.0, 2) AS uu FROM obs o JOIN tt ON o.t < tp),
jj AS (SELECT {EACH.replace('lag', 'tt.lag').replace('site', 'o.site')} AS site, tt.lag * 100 + tp AS grp, tp, o.t, o.value AS y, 1.0::DOUBLE AS one, CAST(o.t AS DOUBLE) AS tt, {XS}, list_sum(a.x) / {MODELS} - list_sum(b.x) / {MODELS} AS m, w
  FROM obs o JOIN tt ON o.t < tp JOIN fl a ON a.site = o.site AND a.t = o.t AND a.lag = tt.lag JOIN fl b ON b.site = o.site AND b.t = tp AND b.lag = tt.lag JOIN w ON w.site = o.site),
jc AS (SELECT *, {', '.join(f'{c} - avg({c}) OVER s AS {c}_c' for c in ['y', 'm', 'tt', *LINES])}, y - m - avg(y - m) OVER s AS r_c FROM jj WINDOW s AS (PARTITION BY site))"""


def grouped_fit(name: str, y: str, xs: list[str]) -> str:
    """CTE of grp, b: the coefficients of xs over the rows of a target and lead, with squared weights."""
    rows = ", ".join("[" + ", ".join(f"sum(w * w * {a} * {b})" for b in [*xs, y]) + "]" for a in xs)
    return f"{name}_n AS (SELECT grp, [{rows}] AS a FROM jc GROUP BY grp), {solved(f'{name}_s', f'{name}_n')}, {name} AS (SELECT grp, {column('len(a) + 1')} AS b FROM {name}_s)"


def pooled_method(fit: str, response: str, xs: list[str]) -> str:
    rest = " - ".join([response, *(f"b[{i}] * {x}" for i, x in enumerate(xs, 1))])
    shift = f"any_value(b)[{xs.index('tt') + 1}] * any_value(tp)" if "tt" in xs else "0"
    return _plain(sql_moments(f"(SELECT jj.*, b FROM jj JOIN {fit} USING (grp))", rest, shift, True))


_GROUPED = {"rawmodel_globlinear": ("g1", "r_c", ["tt"], "y - m"), "rawmodel_globscaled": ("g2", "y_c", ["m"], "y"), "rawmodel_globscaled_globlinear": ("g3", "y_c", ["m", "tt"], "y"), "rawmultimodel_glob": ("g4", "y_c", LINES, "y"), "rawmultimodel_glob_globlinear": ("g5", "y_c", [*LINES, "tt"], "y")}
_TARGET_METHODS = {
    "history": _plain(sql_moments("hh", "y")),
    "linear": _plain(sql_line("hh", "y", "t", "any_value(tp)")),
    "ma": _plain(sql_moments("(SELECT * FROM hh WHERE tp - t <= 12)", "y")),
    "rawmodel": _plain(sql_moments("jj", "y - m", inflate=True)),
    "rawmodel_scaled": _plain(sql_line("jj", "y", "m", "0")),
    "rawmodel_linear": _plain(sql_line("jj", "(y - m)", "t", "any_value(tp)")),
    "rawmodel_globcorr": _plain(sql_moments("(SELECT jj.*, b FROM jj JOIN gc USING (grp))", "y - m - b * t", "any_value(b) * any_value(tp)", True)),
    **{n: pooled_method(fit, response, xs) for n, (fit, _, xs, response) in _GROUPED.items()},
}


def _with_table(name: str, source: str, columns: list[str]) -> str:
    """A method by normal equations, its tables named apart from others'."""
    text = _plain(least_squares(listed(columns, source)))
    for c in ("ne", "so_g", "so", "be", "re", "rs"):
        text = re.sub(rf"\b{c}\b", f"{name}_{c}", text)
    return re.sub(r"\nSELECT (?!.*\nSELECT )", f",\n{name} AS (SELECT ", text) + ")"


SQL["v_targets"] = f"""WITH RECURSIVE {TARGET_PANEL}, {', '.join(grouped_fit(fit, y, [f'{x}_c' for x in xs]) for fit, y, xs, _ in _GROUPED.values())},
gc AS (SELECT grp, regr_slope(g, t) AS b FROM (SELECT grp, t, sum(w * (y - m)) / sum(w) AS g FROM jj GROUP BY 1, 2) GROUP BY 1),
{_with_table('qq', 'hh', ['one', 'u', 'uu'])}, {_with_table('mm', 'jj', ['one', *LINES])},
al AS ({' UNION ALL '.join(f"SELECT '{n}' AS method, site, mu, sigma, nu FROM ({q})" for n, q in _TARGET_METHODS.items())} UNION ALL SELECT 'quadratic', site, mu, sigma, nu FROM qq UNION ALL SELECT 'rawmultimodel', site, mu, sigma, nu FROM mm),
sc AS (SELECT method, CAST(al.site // 100000 AS INTEGER) AS lag, CAST(al.site // 1000 % 100 AS INTEGER) AS t, w, mu - value AS error, {sql_logpdf('((value - mu) / sigma)', 'nu')} - ln(sigma) AS ll FROM al JOIN obs ON obs.site = al.site % 1000 AND obs.t = al.site // 1000 % 100 JOIN w ON w.site = obs.site)
SELECT method, lag, t, count(*) AS n, round(sqrt(sum(w * error * error) / sum(w)), 4) AS rmse, round(sum(w * error) / sum(w), 4) AS bias, round(-sum(w * ll) / sum(w), 6) AS nll FROM sc GROUP BY 1, 2, 3"""
