"""Exact top-k against a full product."""

import numpy as np
from pyspark.sql import functions as F

from foretide.llm import topk


def brute(rows, asked, k=5):
    ok = [(i, np.floor(256 * np.asarray(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for qi in {i for i, _ in ok if i in asked}:
        hits = {(max(-(2**63), min(2**63 - 1, int(sum(int(a) * int(b) for a, b in zip(q, c))))), ci) for i, q in ok if i == qi for ci, c in ok if ci != qi and len(c) == len(q)}
        for n, (s, ci) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1]))[:k]):
            out.add((qi, n + 1, ci, s))
    return out


def test_made(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL_SHARD", 40)
    r = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * r.choice([0.1, 1, 30])]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, rows[3][1]), (2005, [1e9] * 6), (2050, [-1e9] * 6), (2006, [1.0, 2.0]), (2100, [3.0, 1.0]), (50, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("part", F.lit(2))
    got = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], set(range(0, 3000, 50)))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL_SHARD", 3)
    rows = [(0, [1e30, 1.0]), (50, [-1e30, 1.0]), (1, [1e300, -1e300]), (2, [1.0, 2.0]), (3, [1e17, -1e17]), (4, [-3e16, 1e5]), (5, [1e307, 1.0]), (6, [2e15, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute([r for r in rows if r[0] != 5], {0, 50})


def test_bytes_bound_a_shard(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 2000)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == brute(rows, set(range(0, 300, 50)))
