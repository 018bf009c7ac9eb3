"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one numpy batch holds at most (a longer text is a batch of its own).
BATCH_CHARS = 1_000_000

MIX1 = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
MIX3 = np.uint64(0x94D049BB133111EB)
#: Base of the polynomial hashes over word hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0xD1342543DE82EF95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one machine takes a folder of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="foretide-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foretide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once all that is made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = x + MIX1
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word (bytes) -> 64-bit hash; forgets everything when it holds too many words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def hashed(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def text_batches(frames: Iterator, column: str = "text", most: int = BATCH_CHARS) -> Iterator:
    """Arrow record batches cut so that the texts of each hold about `most` bytes at most."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in frames:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end
    # workers live on: what this task needed goes back
    pa.default_memory_pool().release_unused()


def rolling(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of each run of `width` word hashes; len(words) - width + 1 values, by repeated doubling."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, level, size = None, 0, words, 1
    while True:
        if width & size:
            part = level[done : done + n]
            out = part.copy() if out is None else out + part * np.uint64(pow(base, done, 1 << 64))
            done += size
        if done == width:
            return out
        level = level[: len(level) - size] + level[size:] * np.uint64(pow(base, size, 1 << 64))
        size *= 2
