"""Time, quality control, gap filling and transforms of panels."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.special import norm_ppf, t_ppf


# ---- time ----


def days_per_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def shift_month(year: Column, month: Column, by: Column | int) -> tuple[Column, Column]:
    """Year and month `by` months on (back, if negative): roll-over, and initial times from a lead."""
    index = year * 12 + month - 1 + by
    return F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int")


def target_of(day: Column, ahead: int = 2, ready: int = 8) -> tuple[Column, Column, Column]:
    """Year, month and lead of the forecast `ahead` months after a date: forecasts of a month are there after its day `ready`, before that those of the month before."""
    y, m = shift_month(F.year(day), F.month(day), ahead)
    return y.alias("year"), m.alias("month"), (F.when(F.day(day) > ready, ahead).otherwise(ahead + 1)).alias("lag")


def expand_months(spark, years: list[int], months: list[int], how: str = "cross") -> DataFrame:
    """Target months: 'zip' pairs the lists, 'cross' takes all pairs, months fastest; `months_of` takes years from a table."""
    pairs = list(zip(years, months, strict=True)) if how == "zip" else [(y, m) for y in years for m in months]
    return spark.createDataFrame(pairs, "year int, month int")


def season_mean(monthly: DataFrame, keys: list[str], months: list[int]) -> DataFrame:
    """Means over target months by days; monthly (keys, year, month, value). Years without all months are left out."""
    d = monthly.where(F.col("month").isin(months) & F.col("value").isNotNull()).withColumn("days", days_per_month(F.col("year"), F.col("month")))
    g = d.groupBy(*keys, "year").agg((F.sum(F.col("days") * F.col("value")) / F.sum("days")).alias("value"), F.count("*").alias("n"))
    return g.where(F.col("n") == len(months)).drop("n")


def months_of(years: DataFrame, months: list[int]) -> DataFrame:
    """years (year) -> year, month: each year once with each of the months."""
    return years.select("year").distinct().select(F.col("year").cast("int").alias("year"), F.explode(F.array(*map(F.lit, months))).alias("month"))


def right_aligned(panel: DataFrame, targets: list[tuple[int, int]], length: int, values: list[str], keys: list[str]) -> DataFrame:
    """Means by days over the months of a season that may run over the end of a year: keys, year (of the first month), values.

    panel (keys, year, month, values); targets: year and month of each month of the season that is to be predicted. The
    years of each month count backwards from its target (rank 1: the year before), so that a December meets the January
    after it; `length` ranks are kept, as many as the first month has years. Ranks that lack a month are left out. The
    target itself is rank 0 and is kept where the panel has it, as trends do.
    """
    days = {m: days_of(y, m) for y, m in targets}
    at = F.create_map(*(F.lit(x) for y, m in targets for x in (m, y)))
    share = F.create_map(*(x for m, n in days.items() for x in (F.lit(m), F.lit(n / sum(days.values())))))
    d = panel.where(F.col("month").isin([m for _, m in targets])).withColumn("rank", at[F.col("month")] - F.col("year")).where(F.col("rank").between(0, length))
    n = len(targets)
    sums = [F.when(F.count(v) == n, F.sum(share[F.col("month")] * F.col(v))).alias(v) for v in values]
    g = d.groupBy(*keys, "rank").agg(F.count("*").alias("_n"), *sums).where(F.col("_n") == n)
    return g.select(*keys, (F.lit(targets[0][0]) - F.col("rank")).cast("int").alias("year"), *values)


def days_of(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


# ---- quality ----


def clean_forecast(value: Column, zero_is_missing: Column | bool = False) -> Column:
    """Sentinels to null: over 1E20, negative, and zero where that can't be."""
    zero = zero_is_missing if isinstance(zero_is_missing, Column) else F.lit(zero_is_missing)
    return F.when(~F.isnan(value) & (value <= 1e20) & (value >= 0) & ~(zero & (value == 0)), value)


def complete_sites(obs: DataFrame, n_times: int) -> DataFrame:
    """The rows of sites that have a value at every time."""
    whole = obs.groupBy("site").agg(F.count("value").alias("n")).where(F.col("n") == n_times).select("site")
    return obs.join(whole, "site", "left_semi")


def usable_models(fcst: DataFrame) -> DataFrame:
    """The rows of models for which no site lacks every value."""
    never = fcst.groupBy("model", "site").agg(F.count("value").alias("n")).where("n = 0").select("model").distinct()
    return fcst.join(never, "model", "left_anti")


def ensemble_summary(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, spread and number of members."""
    return raw.groupBy(*keys).agg(F.avg("value").alias("vals_mean"), F.stddev_samp("value").alias("vals_sd"), F.count("value").alias("nr"))


def times_of(present: DataFrame, times: list[int]) -> DataFrame:
    """The times as rows; one that no row has is an error."""
    known = present.groupBy("t").agg(F.count("*").alias("n"))
    asked = present.sparkSession.createDataFrame([(t,) for t in times], f"t {dict(present.dtypes)['t']}")
    lacks = F.raise_error(F.concat(F.lit("no forecasts in year "), F.col("t").cast("string"))).cast("int")
    return asked.join(known, "t", "left").select(F.when(F.col("n").isNotNull(), F.col("t")).otherwise(lacks).alias("t"))


def fill_missing_years(fcst: DataFrame, times: list[int] | None = None) -> DataFrame:
    """fcst (site, t, model, value, and sd if there is a spread): rows for every model in every year of a site.

    A model without a year takes the mean of the models present in that year, plus its mean difference from the mean of
    those models over the years in which all models are present; its spread is the root of its mean square over years.
    Without any such year, or any model in the year at a site, the value stays null. `filled` marks the rows made. times:
    the years of each site; one without a forecast of any model anywhere is an error.
    """
    spread = "sd" in fcst.columns
    present = fcst.where(F.col("value").isNotNull()).select("site", "t", "model", "value", *(["sd"] if spread else [])).repartition("site")
    models = F.broadcast(present.agg(F.sort_array(F.collect_set("model")).alias("models")))  # one row, a handful of names
    d = present.crossJoin(models).withColumn("n", F.count("*").over(Window.partitionBy("site", "t")))
    whole = F.when(F.col("n") == F.size("models"), F.col("value"))
    rms = [F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("rms")] if spread else []
    # means over the same years: their differences are the means of differences, whichever models a gap has beside it
    base = d.groupBy("site", "model").agg(F.avg(whole).alias("base"), *rms)
    year = d.join(base.select("site", "model", "base"), ["site", "model"]).groupBy("site", "t").agg(F.avg("value").alias("mean"), F.avg("base").alias("mean_base"))
    if times is not None:
        any_ = times_of(present, times)
        year = present.select("site").distinct().crossJoin(F.broadcast(any_)).join(year, ["site", "t"], "left")
    grid = year.crossJoin(models).select("site", "t", "mean", "mean_base", F.explode("models").alias("model"))
    out = grid.join(present, ["site", "t", "model"], "left").join(base, ["site", "model"], "left")
    made = F.col("value").isNull()
    columns = [F.coalesce("value", F.col("mean") + F.col("base") - F.col("mean_base")).alias("value")]
    columns += [F.when(made, F.col("rms")).otherwise(F.col("sd")).alias("sd")] if spread else []
    return out.select("site", "t", "model", *columns, made.alias("filled"))


def fill_from_neighbours(df: DataFrame, keys: list[str], order: str, period: int | None = None) -> DataFrame:
    """The nearest value along `order` within keys, the lower side of equally near ones; circular where a period is given."""
    d = df.withColumn("_copy", F.lit(0))
    if period:
        d = df.withColumn("_copy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(order, F.col(order) + F.col("_copy") * period)
    at = F.when(F.col("value").isNotNull(), F.struct(F.col(order).alias("o"), F.col("value").alias("v")))
    w = Window.partitionBy(*keys).orderBy(order)
    d = d.withColumn("_l", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    left = F.coalesce(F.col(order) - F.col("_l.o") <= F.col("_r.o") - F.col(order), F.col("_l").isNotNull())
    return d.where("_copy = 0").withColumn("filled", F.when(left, F.col("_l.v")).otherwise(F.col("_r.v"))).drop("_l", "_r", "_copy")


def fill_row_mean(df: DataFrame, row: str, keys: list[str] | None = None) -> DataFrame:
    """Missing values take the mean of their row (a latitude) within keys (a month), rows without values that of the nearest row."""
    keys = keys or []
    means = df.groupBy(*keys, row).agg(F.avg("value").alias("value"))
    means = fill_from_neighbours(means if keys else means.withColumn("_all", F.lit(1)), keys or ["_all"], row).select(*keys, row, F.col("filled").alias("_mean"))
    return df.join(means, [*keys, row]).withColumn("filled", F.coalesce("value", "_mean")).drop("_mean")


# ---- series ----


def anomalies(df: DataFrame, keys: list[str], by: Column | None = None) -> DataFrame:
    """value less its mean within keys (and a season, if given)."""
    w = Window.partitionBy(*keys, *([by] if by is not None else []))
    return df.withColumn("anomaly", F.col("value") - F.avg("value").over(w))


def detrended(df: DataFrame, keys: list[str]) -> DataFrame:
    w, t = Window.partitionBy(*keys), F.col("t").cast("double")
    return df.withColumn("detrended", F.col("value") - F.avg("value").over(w) - F.regr_slope("value", t).over(w) * (t - F.avg(t).over(w)))


def trailing_mean(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.withColumn("smooth", F.avg("value").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - n, 0)))


def zero_mean_test(df: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the t test of a zero mean with lag-one correction: n, mean, sd, n_adj, t."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_c", F.col("value") - F.avg("value").over(w)).withColumn("_next", F.lead("_c").over(w.orderBy("t")))
    g = d.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum(F.col("_c") * F.col("_next")).alias("_s"))
    r = F.col("_s") / (F.col("n") - 1) / F.pow("sd", 2)
    g = g.withColumn("n_adj", F.col("n") * (1 - r) / (1 + r)).drop("_s")
    return g.withColumn("t", F.sqrt("n_adj") * F.col("mean") / F.col("sd"))


def zero_mean_width(test: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The parts of `zero_mean_test` with dt, half the width of the mean's interval."""
    return test.withColumn("dt", F.col("sd") / F.sqrt("n_adj") * t_ppf(F.lit(1 - alpha / 2), F.col("n_adj") - 1))


def records(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, t, value): the level to beat, whether it is a record, and its chance without a trend, 1 / (earlier + 1)."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("level", F.max("value").over(w)).withColumn("n_before", F.count("value").over(w))
    return d.withColumn("is_record", F.col("value") > F.col("level")).withColumn("p_stationary", 1 / (F.col("n_before") + 1))


# ---- normal scores and quantiles ----


def average_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("avg_rank", F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy(*keys, "value")) - 1) / 2)


def normal_scores(df: DataFrame, keys: list[str]) -> DataFrame:
    """value -> quantile of the normal at rank / (n + 1); nulls take no part."""
    d = average_ranks(df.where(F.col("value").isNotNull()), keys)
    return d.withColumn("score", norm_ppf(F.col("avg_rank") / (F.count("*").over(Window.partitionBy(*keys)) + 1)))


def transform_scores(other: DataFrame, base: DataFrame, keys: list[str], cap: bool = True) -> DataFrame:
    """Values of `other` on the piecewise linear map from base's values to their scores; end pieces go on, extremes are capped."""
    s = normal_scores(base, keys)
    n = s.groupBy(*keys).agg(F.count("*").alias("_n"))
    knots = s.groupBy(*keys, "value").agg(F.min("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy("value")
    knots = knots.select(*keys, F.col("value").alias("_x0"), F.col("score").alias("_y0"), F.lead("value").over(w).alias("_x1"), F.lead("score").over(w).alias("_y1"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*keys)).alias("_k"))
    piece = knots.where("_i < _k OR _k = 1")
    j = other.join(piece, keys).where(((F.col("value") >= F.col("_x0")) | (F.col("_i") == 1)) & ((F.col("value") < F.col("_x1")) | (F.col("_i") >= F.col("_k") - 1)))
    score = F.when(F.col("_k") == 1, F.lit(0.0)).otherwise(F.col("_y0") + (F.col("value") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0")))
    j = j.join(n, keys).withColumn("score", score)
    if cap:
        top = -norm_ppf(1 / (F.col("_n") + F.count("*").over(Window.partitionBy(*keys)) + 1))
        j = j.withColumn("score", F.greatest(-top, F.least(top, F.col("score"))))
    return j.drop("_x0", "_x1", "_y0", "_y1", "_i", "_k", "_n")


def values_at(base: DataFrame, wanted: DataFrame, keys: list[str], column: str = "quantile") -> DataFrame:
    """The inverse of normal scores: wanted (keys, quantile) -> value, on the line between the sorted values of base (keys, value) at scores of k / (n + 1).

    End pieces go on. A key with one value has that value at every quantile; quantiles outside (0, 1) give null.
    """
    s = base.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_s"))
    d = wanted.join(s, keys).withColumn("_n", F.size("_s"))
    k = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col(column) * (F.col("_n") + 1)).cast("int")))
    d = d.withColumn("_k", k)
    score = lambda i: norm_ppf(i / (F.col("_n") + 1))
    low, high = F.element_at("_s", F.col("_k")), F.element_at("_s", F.least(F.col("_k") + 1, F.col("_n")))
    z0, z1 = score(F.col("_k")), score(F.col("_k") + 1)
    z = norm_ppf(F.col(column))
    value = F.when(z.isNull(), None).when(F.col("_n") == 1, low).otherwise(low + (z - z0) / (z1 - z0) * (high - low))
    return d.withColumn("value", value).drop("_s", "_n", "_k")


#: Bins of a histogram that narrows quantiles down, values of a bin that are sorted at once, keys at most.
BINS, FEW, MOST_KEYS = 1024, 4096, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], qs: list[float], hazen: bool = True) -> DataFrame:
    """As `quantiles`, for few keys (up to MOST_KEYS, else an error) of any size: no task holds a key's values.

    Every order statistic is narrowed down by histograms of its key's range, counted in all tasks: a round keeps the bin
    that holds it, from that bin's least to its greatest value, until few values are left, which are sorted. A round is
    a job that sends a row for each key and open order statistic to the driver.
    """
    spark, keys = df.sparkSession, list(keys)
    d = df.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"))
    shape = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 0").limit(MOST_KEYS + 1).collect()
    if len(shape) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    kinds = dict(df.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    found, open_, shares = {}, {}, {}
    for r in shape:
        key = tuple(r[k] for k in keys)
        for i, q in enumerate(qs):
            place = max(1.0, min(float(r["n"]), q * r["n"] + 0.5)) if hazen else 1 + q * (r["n"] - 1)
            low = int(place + 1e-12)
            shares[key, i] = place - low
            for j in (0, 1):
                open_[key, i, j] = (min(low + j, r["n"]), r["lo"], r["hi"], r["n"])
    while open_:
        found |= {k: lo for k, (_, lo, hi, _) in open_.items() if lo == hi}
        open_ = {k: v for k, v in open_.items() if k not in found}
        few = sorted({(k[0], lo, hi) for k, (_, lo, hi, n) in open_.items() if n <= FEW}, key=str)
        many = sorted({(k[0], lo, hi) for k, (_, lo, hi, n) in open_.items() if n > FEW}, key=str)

        def inside(spans: list) -> DataFrame:
            rows = spark.createDataFrame([(*k, n, lo, hi) for n, (k, lo, hi) in enumerate(spans)], f"{schema}span long, lo double, hi double")
            met = d.join(F.broadcast(rows), keys) if keys else d.crossJoin(F.broadcast(rows))  # at most MOST_KEYS times the order statistics
            return met.where(F.col("value").between(F.col("lo"), F.col("hi")))

        if few:
            got = {few[r["span"]]: r["s"] for r in inside(few).groupBy("span").agg(F.sort_array(F.collect_list("value")).alias("s")).collect()}
            found |= {k: got[k[0], lo, hi][rank - 1] for k, (rank, lo, hi, _) in open_.items() if (k[0], lo, hi) in got}
            open_ = {k: v for k, v in open_.items() if k not in found}
        if many:
            at = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
            hist = inside(many).groupBy("span", F.least(F.lit(BINS - 1), at).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            upto = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("span").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
            names = {s: n for n, s in enumerate(many)}
            asked = list(open_)
            wanted = spark.createDataFrame([(n, names[k[0], open_[k][1], open_[k][2]], open_[k][0]) for n, k in enumerate(asked)], "w long, span long, rank long")
            hit = upto.join(F.broadcast(wanted), "span").where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
            for r in hit.select("w", "rank", "upto", "n", "lo", "hi").collect():
                open_[asked[r["w"]]] = (r["rank"] - (r["upto"] - r["n"]), r["lo"], r["hi"], r["n"])
    values = {(k, i): (found[k, i, 0], found[k, i, 1]) for k, i in shares}
    rows = [(*key, [a + shares[key, i] * (b - a) for i in range(len(qs)) for a, b in [values[key, i]]]) for key in dict.fromkeys(k for k, _ in shares)]
    return spark.createDataFrame(rows, f"{schema}quantiles array<double>")


def quantile(df: DataFrame, keys: list[str], q: float, hazen: bool = True) -> DataFrame:
    """Quantiles with (k - 1/2)/n at the kth value (Hazen), or (k - 1)/(n - 1)."""
    return quantiles(df, keys, [q], hazen).select(*keys, F.col("quantiles")[0].alias("quantile"))


def quantiles(df: DataFrame, keys: list[str], qs: list[float], hazen: bool = True) -> DataFrame:
    """Several quantiles of each key as an array. Equal values are counted before keys meet, so a key costs its distinct values."""
    counts = df.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("m").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(w))
    at = [F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), q * F.col("n") + 0.5)) if hazen else 1 + q * (F.col("n") - 1) for q in qs]
    # the kth value is the first whose running count reaches k
    low = [F.floor(h + 1e-12) for h in at]
    reach = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    parts = [reach(k).alias(f"a{i}") for i, k in enumerate(low)] + [reach(F.least(k + 1, F.col("n"))).alias(f"b{i}") for i, k in enumerate(low)] + [F.first(h - k).alias(f"f{i}") for i, (h, k) in enumerate(zip(at, low))]
    g = upto.groupBy(*keys).agg(*parts)
    return g.select(*keys, F.array(*(F.col(f"a{i}") + F.col(f"f{i}") * (F.col(f"b{i}") - F.col(f"a{i}")) for i in range(len(qs)))).alias("quantiles"))
