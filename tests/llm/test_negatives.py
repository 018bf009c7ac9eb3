"""Hard negatives against a scan of all pairs; units, windows and radii on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=5, k=3, least=80):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        e = (label, [float(math.floor(256 * x)) for x in v])
        seen[i] = min(seen.get(i, e), e)
    out = []
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b))))
    for a, (label, v) in seen.items():
        if a % every:
            continue
        scores = [(-dot(v, w), i, other == label) for i, (other, w) in seen.items() if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2])[:k]:
            fits = sorted(x for x in scores if not x[2] and least * -s <= 100 * -x[0] <= 100 * -s)
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits[:k])]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, id int, pivot string").repartition(3)
    d = N.hard_negatives(df, F.col("id") % 5 == 0, k_positive=3, k_negative=3, **kw)
    return sorted(tuple(r) for r in d.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["clusters", "few values", "sizes"])
def test_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "SMALL_UNIT", 20)
    monkeypatch.setattr(N, "STEP", 4)
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    monkeypatch.setattr(N, "PIVOTS", 5)
    r = np.random.default_rng(3)
    if kind == "clusters":
        c = r.normal(size=(6, 4))
        v = [(c[i % 6] + 0.1 * r.normal(size=4)).tolist() for i in range(240)]
    elif kind == "few values":
        v = [[float(x) for x in r.integers(-1, 2, size=3)] for _ in range(240)]
    else:
        v = [(r.normal(size=r.integers(1, 4)) * 10.0 ** r.integers(-2, 4)).tolist() for _ in range(240)]
    rows = [(i, int(r.integers(0, 3)), x) for i, x in enumerate(v)]
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_odd_rows(spark):
    r = random.Random(2)
    v = lambda: [r.choice([0.5, -0.25, 1.0]) for _ in range(2)]
    rows = [(i, r.choice([0, 1]), v()) for i in range(60)]
    rows += [(None, 0, v()), (61, None, v()), (62, 1, None), (63, 1, []), (64, 1, [float("nan"), 1.0]), (65, 1, [float("inf"), 1.0]), (66, 1, [1e308, 1.0]), (67, 0, [1.0]), (70, 0, [2.0]), (68, 1, [1.5])]
    rows += rows[:20] + [(5, 1, v()), (10, 0, v())]
    assert found(spark, rows) == brute([x for x in rows if x[0] != 66])
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_huge_components(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 2, (r.normal(size=3) * 10.0 ** r.integers(4, 12)).tolist()) for i in range(50)]
    rows += [(i, i % 2, [1e200 * (-1) ** i, 1e150, 3.0]) for i in range(50, 60)]
    assert found(spark, rows) == brute(rows)


def test_many_copies(spark):
    """A third of all rows is one vector; its units are cut by id."""
    r = np.random.default_rng(5)
    rows = [(i, i % 3, [0.5, 0.5] if i % 3 else r.normal(size=2).tolist()) for i in range(900)]
    assert found(spark, rows) == brute(rows)


def test_radius_leaves_units_out(spark):
    """Far clusters are not asked: the first unit's kth score is radius enough."""
    r = np.random.default_rng(6)
    c = 40 * r.normal(size=(20, 6))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    rows = [(i, i % 2, (c[i % 20] + 0.001 * r.normal(size=6)).tolist()) for i in range(2000)]
    d = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(256 * x).cast("double")).alias("v"))
    s = N.Search(d, F.col("id") % 5 == 0)
    asked = []
    ask = s.ask
    s.ask = lambda places, *a: (asked.append(places.count()), ask(places, *a))[1]
    free = s.anchors.select("id", F.array(F.lit(N.FREE)).alias("low"), F.array(F.lit(N.MOST_LONG)).alias("top"))
    assert s.first(free, 1, True, 3).count() == 1200
    assert asked[0] == 400 and asked[1] < 400 * (s.units.count() - 1) / 2
