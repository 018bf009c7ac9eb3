"""Panels made of the supplied star schema: prices by nation and quarter stand for observations, priorities for models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers are nulls everywhere, so that aggregates skip them."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def quarter(date: str = "o_orderdate"):
    return ((F.year(date) - 1995) * 4 + F.quarter(date)).cast("int")


def month(date: str = "o_orderdate"):
    return ((F.year(date) - 1995) * 12 + F.month(date)).cast("int")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("site", F.col("c_nationkey").cast("long"))


#: Rows that one task makes, about, where each site gets the rows of its group.
FANNED_ROWS = 250_000


def fanned(sites: DataFrame, shared: DataFrame, on: str, each: int) -> DataFrame:
    """sites (site, on) with all rows of shared (on, ...), a small table; each: about as many as a site gets.

    Sites are dealt out first, by their number: a table of sites is a small file, read by one task, and that task would
    make the rows of all sites.
    """
    return sites.repartition(max(1, math.ceil(sites.count() * each / FANNED_ROWS)), "site").join(F.broadcast(shared), on)


def obs_panel(spark: SparkSession, sf_dir: str, monthly: bool = False) -> DataFrame:
    """site, t, value."""
    return _orders(spark, sf_dir).groupBy("site", (month() if monthly else quarter()).alias("t")).agg(F.avg("o_totalprice").alias("value"))


def fcst_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, model, value: each nation has the forecasts of its region."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("site"), "n_regionkey")
    regional = _orders(spark, sf_dir).join(nations, "site").groupBy("n_regionkey", quarter().alias("t"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("value"))
    return nations.join(regional, "n_regionkey").select("site", "t", "model", "value")


def fcst_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, model, lag, value: lead 1 as fcst_panel, lead 2 what that gave for the quarter before."""
    both = fcst_panel(spark, sf_dir).withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.withColumn("t", (F.col("t") + F.col("lag") - 1).cast("int"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("site"), quarter("l_shipdate").alias("t"), F.concat(F.lit("line"), F.least("l_linenumber", F.lit(5)).cast("string")).alias("model"), "l_extendedprice")


def supplier_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, value: prices by supplier and quarter, so that the number of sites grows with the tables."""
    return _lines(spark, sf_dir).groupBy("site", "t").agg(F.avg("l_extendedprice").alias("value"))


def supplier_fcst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, model, value: each supplier has the prices of its region by place on the order."""
    region = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("long").alias("site"), "n_regionkey")
    regional = _lines(spark, sf_dir).join(region, "site").groupBy("n_regionkey", "t", "model").agg(F.avg("l_extendedprice").alias("value"))
    return fanned(region, regional, "n_regionkey", 140).select("site", "t", "model", "value")


def supplier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("site").agg(F.count("*").cast("double").alias("w"))


def long_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, value: prices by region and six days, over 400 times long."""
    region = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").cast("long").alias("site"))
    d = table(spark, sf_dir, "lineitem").join(region, "l_suppkey")
    return d.groupBy("site", F.floor(F.datediff("l_shipdate", F.lit("1995-01-01")) / 6).cast("int").alias("t")).agg(F.avg("l_extendedprice").alias("value"))


def part_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, value: prices by part and half-year: very many sites, with gaps."""
    half = ((F.year("l_shipdate") - 1995) * 2 + F.ceil(F.month("l_shipdate") / 6)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("site"), half.alias("t")).agg(F.avg("l_extendedprice").alias("value"))


def part_fcst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, t, model, value: each part has the prices of its size by place on the order."""
    half = ((F.year("l_shipdate") - 1995) * 2 + F.ceil(F.month("l_shipdate") / 6)).cast("int")
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("site"), "p_size")
    model = F.concat(F.lit("line"), F.least("l_linenumber", F.lit(3)).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("site"), half.alias("t"), model.alias("model"), "l_extendedprice")
    by_size = lines.join(sizes, "site").groupBy("p_size", "t", "model").agg(F.avg("l_extendedprice").alias("value"))
    return fanned(sizes, by_size, "p_size", 42).select("site", "t", "model", "value")


def fcst_gappy(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """site, t, model, value and, if asked, sd: by nation, so that some are missing."""
    more = [F.stddev_samp("o_totalprice").alias("sd")] if spread else []
    return _orders(spark, sf_dir).groupBy("site", quarter().alias("t"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("value"), *more)


def site_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, w: the share of customers."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("site")).agg(F.count("*").cast("double").alias("w"))
