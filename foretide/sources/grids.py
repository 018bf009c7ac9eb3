"""Readers of gridded files: flat big-endian floats in records, and Parquet panels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_flat_grid(spark: SparkSession, path: str, n_lon: int, n_lat: int, start_year: int, missing: float = -999.0) -> DataFrame:
    """Records of big-endian 32-bit floats, one month each, every record between two 4-byte lengths.

    A task reads some records of a file, never a whole one: year, month, lat, lon (indices), value.
    """
    size = 4 * n_lon * n_lat + 8
    kind = "org.apache.hadoop.io.", "org.apache.spark.input.FixedLengthBinaryInputFormat"
    records = spark.sparkContext.newAPIHadoopFile(path, kind[1], f"{kind[0]}LongWritable", f"{kind[0]}BytesWritable", conf={f"{kind[1]}.recordLength": str(size)})
    raw = spark.createDataFrame(records.map(lambda r: (r[0], bytearray(r[1]))), "i long, body binary")

    def decode(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for i, body in zip(pdf["i"], pdf["body"]):
                v = np.frombuffer(body, ">f4")[1:-1].astype(float)
                lat, lon = np.divmod(np.arange(len(v)), n_lon)
                yield pd.DataFrame({"year": np.int32(start_year + i // 12), "month": np.int32(i % 12 + 1), "lat": lat.astype(np.int32), "lon": lon.astype(np.int32), "value": v})

    out = raw.mapInPandas(decode, "year int, month int, lat int, lon int, value double")
    return out.withColumn("value", F.when((F.col("value") != missing) & ~F.isnan("value"), F.col("value")))


def read_panel(spark: SparkSession, path: str, years: tuple[int, int] | None = None, month: int | None = None) -> DataFrame:
    """A Parquet panel partitioned by month; year and month filters reach the scan."""
    df = spark.read.parquet(path)
    if years:
        df = df.where(F.col("year").between(*years))
    return df if month is None else df.where(F.col("month") == month)


def write_panel(df: DataFrame, path: str, parts: int = 16) -> None:
    """A panel by month; each month is written by up to `parts` tasks, whole sites to one."""
    df.repartition(12 * parts, "month", F.pmod(F.xxhash64("site"), F.lit(parts))).write.mode("overwrite").partitionBy("month").parquet(path)
