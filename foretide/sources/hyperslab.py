"""A Spark data source of flat gridded files that reads hyperslabs: only the records and rows of the grid that are asked for.

A file holds records of big-endian 32-bit floats, one month each, latitude by latitude, every record between two 4-byte
lengths. A path is one file, whose first record is January of `start_year`, or a folder of files whose names are the
year of their first record (`1990.bin`). The asked years, months and latitudes are options of the source: the driver turns
them into runs of records (a number for each month), and tasks seek there. They are options rather than pushed filters as
Spark 4.1 keeps the last filters pushed into a Python source for all uses of one DataFrame: a union of two
slabs of it, or the whole of it after a slab, lost rows.

Rows: year, month, lat, lon (indices from 0), value; the missing value and NaN are null. An incomplete record at the end
of a file is an error. A file without records, or a slab outside the files, gives no rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AXES = ("year", "month", "lat", "lon")
SCHEMA = "year int, month int, lat int, lon int, value double"
#: Bytes of records in one task, about.
TASK_BYTES = 32 << 20


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


@dataclass
class Slab(InputPartition):
    """Records of one file, their months (counted from January of year 0), and the first and last latitude to read."""

    path: str
    records: np.ndarray
    months: np.ndarray
    low: int
    high: int


class HyperslabReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.n_lon, self.n_lat = int(options["n_lon"]), int(options["n_lat"])
        self.start_year = int(options["start_year"]) if options.get("start_year") else None
        self.missing = float(options.get("missing", "-999"))
        self.years, self.months, self.lats = ([int(i) for i in options[k].split(",") if i] if k in options else None for k in ("years", "months", "lats"))

    def files(self) -> list[tuple[str, int, int]]:
        """path, bytes and first year of each file."""
        from pyarrow import fs

        system, where = file_system(self.path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.File:
            if self.start_year is None:
                raise ValueError("a single file needs start_year")
            return [(where, info.size, self.start_year)]
        found = [(i.path, i.size, i.base_name.split(".")[0]) for i in system.get_file_info(fs.FileSelector(where)) if i.type == fs.FileType.File]
        return sorted((p, size, int(name)) for p, size, name in found if name.isdigit())

    def partitions(self) -> list[Slab]:
        out, size = [], 4 * self.n_lon * self.n_lat + 8
        low, high = (max(0, self.lats[0]), min(self.n_lat - 1, self.lats[1])) if self.lats else (0, self.n_lat - 1)
        if low > high:
            return out
        most = max(1, TASK_BYTES // (4 * self.n_lon * (high - low + 1)))
        for path, n_bytes, year in self.files():
            if n_bytes % size:
                raise ValueError(f"{path} has no whole number of records of {size} bytes")
            records = np.arange(n_bytes // size)
            months = 12 * year + records
            asked = np.ones(len(months), bool)
            if self.years:
                asked &= (months // 12 >= self.years[0]) & (months // 12 <= self.years[1])
            if self.months is not None:
                asked &= np.isin(months % 12 + 1, self.months)
            records, months = records[asked], months[asked]
            out += [Slab(path, records[i : i + most], months[i : i + most], low, high) for i in range(0, len(records), most)]
        return out

    def read(self, partition: Slab | None) -> Iterator:
        import pyarrow as pa

        if partition is None:
            return
        rows = partition.high - partition.low + 1
        lat = pa.array(np.repeat(np.arange(partition.low, partition.high + 1, dtype=np.int32), self.n_lon))
        lon = pa.array(np.tile(np.arange(self.n_lon, dtype=np.int32), rows))
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            for record, month in zip(partition.records.tolist(), partition.months.tolist()):
                body = file.read_at(4 * self.n_lon * rows, record * (4 * self.n_lon * self.n_lat + 8) + 4 + 4 * self.n_lon * partition.low)
                value = np.frombuffer(body, ">f4").astype(float)
                axes = [pa.array(np.full(len(value), i, np.int32)) for i in (month // 12, month % 12 + 1)]
                yield pa.RecordBatch.from_arrays([*axes, lat, lon, pa.array(value, mask=np.isnan(value) | (value == self.missing))], names=[*AXES, "value"])


class HyperslabSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hyperslab"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HyperslabReader:
        return HyperslabReader(dict(self.options))


def read_hyperslab(spark: SparkSession, path: str, n_lon: int, n_lat: int, start_year: int | None = None, missing: float = -999.0, years: tuple[int, int] | None = None, months: list[int] | None = None, lats: tuple[int, int] | None = None) -> DataFrame:
    """year, month, lat, lon, value of a flat file or folder: of the years from the first to the last given, the months of
    the year, and the latitudes (indices) from the first to the last; None for all, no months for no rows."""
    spark.dataSource.register(HyperslabSource)
    options = {"n_lon": n_lon, "n_lat": n_lat, "missing": missing} | ({} if start_year is None else {"start_year": start_year})
    options |= {k: ",".join(map(str, v)) for k, v in (("years", years), ("months", months), ("lats", lats)) if v is not None}
    return spark.read.format("hyperslab").options(**options).load(path)


def write_hyperslabs(df: DataFrame, path: str, n_lon: int, n_lat: int, missing: float = -999.0) -> None:
    """df (year, month, lat, lon, value) -> a folder of flat files, one a year, each written by one task; absent cells are missing.

    A task holds one year of the grid. It writes a file of its own and moves it to its name, so a repeated task changes nothing.
    """
    folder = path

    def write(rows):
        import pandas as pd

        grid = np.full((12, n_lat, n_lon), missing, ">f4")
        known = rows[rows["value"].notna()]
        grid[known["month"] - 1, known["lat"], known["lon"]] = known["value"]
        edge = np.asarray([4 * n_lat * n_lon], ">i4").tobytes()
        year = int(rows["year"].iloc[0])
        system, where = file_system(folder)
        system.create_dir(where, recursive=True)
        part = f"{where}/part-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            for month in grid:
                out.write(edge + month.tobytes() + edge)
        system.move(part, f"{where}/{year}.bin")
        return pd.DataFrame({"year": [np.int32(year)]})

    df.where("year IS NOT NULL").select(*AXES, "value").groupBy("year").applyInPandas(write, "year int").write.format("noop").mode("overwrite").save()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local run takes one of its own and a cluster gets an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="foretide-")
    return f"{where}/foretide-{uuid.uuid4().hex}"
