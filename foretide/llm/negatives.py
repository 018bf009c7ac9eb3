"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest norm (0 for an anchor), so that an inner product s
becomes a distance: d^2 = |q|^2 + M^2 - 2 s. Each vector is filed under its nearest pivot by its distance from it, and
the file is sorted by (pivot, distance) and cut into units of bounded bytes. A vector at distance d from an anchor lies
in the annulus of keys within d of the anchor's own distance from the pivot. So a search begins with the unit at the
anchor's key, whose kth score gives a radius; the other units are asked only where their keys meet the annulus of that
radius, and in a unit the key interval grows outwards, `STEP` keys at a time, until what remains is farther than the
kth found or, in a window of scores, too near. Which is exact: no vector outside the annuli can be among the first k.

Two searches follow each other: the positives of each anchor (its own label), and for all its positives at once the
rows of other labels whose score is within a window under the positive's. `PIVOTS` pivots are means of a sample of
`SAMPLE` vectors with the least hashes of their ids; every vector is filed and searched. Components turn into integers
floor(scale * x) in double arithmetic. Scores are exact, in double where all products are under 2**53, else in Python
integers; a score beyond the range of a long takes the end of that range. Bounds carry a margin for rounding.

Rows: a null id, a null label, vectors that are null, empty or hold a null or non-finite component (before or after
scaling) take no part. Rows that share an id are one vector: the one with the least label and components. Vectors meet
others of their own length only. Ties of score go to the smaller id. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm.common import discard, stored
from foretide.llm.topk import usable, whole

#: Pivots of a vector length at most, and the sample they come from.
PIVOTS, SAMPLE = 32, 2048
#: Keys that a search takes at once; bytes of a unit, about; anchors of a block.
STEP, UNIT_BYTES, BLOCK_ROWS = 256, 16_000_000, 1024
#: So many units at least, of so many vectors each.
LEAST_UNITS, SMALL_UNIT = 32, 256
MOST_LONG = 2**63 - 1
FREE = -MOST_LONG - 1


def means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of the rows of x, from its first rows by Lloyd's steps."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[near == i].mean(0) for i in np.unique(near)])
    return c


class Pivots:
    """Pivots of each vector length, in the space with one component more; a length that the sample lacks has the origin."""

    def __init__(self, sample: list[np.ndarray], most2: float):
        self.most2, self.of = most2, {}
        with np.errstate(all="ignore"):
            for dim in {len(v) for v in sample}:
                c = means(self.filed(np.stack([v for v in sample if len(v) == dim])), PIVOTS)
                self.of[dim] = c if np.isfinite(c).all() else np.zeros((1, dim + 1))

    def filed(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.most2 - (x * x).sum(1, keepdims=True)))])

    def at(self, dim: int) -> np.ndarray:
        return self.of.get(dim, np.zeros((1, dim + 1)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each row of x (filed) from each pivot; inf where it can't be told."""
        d = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.at(x.shape[1] - 1)], 1)
        return np.where(np.isfinite(d), d, np.inf)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def by_length(batch) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the rows of a batch of each vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def file_keys(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows (id, label, dim, v) -> the same with pivot and dist."""

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, places in by_length(batch):
                part = batch.take(pa.array(places))
                with np.errstate(all="ignore"):
                    d = pivots.distances(pivots.filed(_matrix(part.column("v"))))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "label", "dim", "v", "pivot", "dist"])

    return rows.select("id", "label", "dim", "v").mapInArrow(keyed, "id long, label long, dim int, v array<double>, pivot int, dist double")


def anchor_keys(anchors: DataFrame, pivots: Pivots) -> DataFrame:
    """anchors (id, dim, v) -> id, dim, pivot, dq (its distance from each pivot), size2 (|q|^2 + M^2), nearest (whether this is its nearest)."""

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for dim, places in by_length(batch):
                part = batch.take(pa.array(places))
                x = _matrix(part.column("v"))
                with np.errstate(all="ignore"):
                    d = pivots.distances(np.hstack([x, np.zeros((len(x), 1))]))
                    size2 = (x * x).sum(1) + pivots.most2
                n, k = d.shape
                columns = [np.repeat(part.column("id").to_numpy(), k), np.full(n * k, dim, np.int32), np.tile(np.arange(k, dtype=np.int32), n), d.ravel(), np.repeat(np.where(np.isfinite(size2), size2, np.inf), k), (np.arange(k)[None] == d.argmin(1)[:, None]).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "dim", "pivot", "dq", "size2", "nearest"])

    return anchors.select("id", "dim", "v").mapInArrow(keyed, "id long, dim int, pivot int, dq double, size2 double, nearest boolean")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return np.asarray([[max(FREE, min(MOST_LONG, sum(int(a) * int(b) for a, b in zip(r, c)))) for c in x] for r in q], np.int64).reshape(len(q), len(x))


def limits(size2, near, far):
    """The greatest and the least score at distances from near to far, with a margin for rounding."""
    margin = 1e-9 * (np.abs(size2) + near * near) + 1e-6
    high, low = (size2 - near * near) / 2 + margin, (size2 - far * far) / 2 - margin - 1e-9 * far * far
    return np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), -np.inf, low)


class Unit:
    """Vectors of one pivot in the order of their distances from it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, dist: np.ndarray, x: np.ndarray):
        order = np.argsort(dist, kind="stable")
        self.ids, self.labels, self.dist, self.x = ids[order], labels[order], dist[order], x[order]
        self.start = np.arange(0, len(ids), STEP)
        self.end = np.minimum(self.start + STEP, len(ids))

    def search(self, q_ids, q_labels, q, dq, size2, low, top, same: bool, k: int):
        """The first k of each anchor and window (low to top, both included) among rows of its own label (same) or of others: anchor, window, score, id."""
        n, w = low.shape
        low, first, last = low.copy(), self.dist[self.start], self.dist[self.end - 1]
        near = np.maximum(0, np.maximum(first[None] - dq[:, None], dq[:, None] - last[None]))
        near = np.where(np.isfinite(near), near, 0)
        high, least = limits(size2[:, None], near, dq[:, None] + last[None])
        order = np.argsort(near, 1, kind="stable")
        key, score, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        everyone = np.arange(n)
        for step in order.T:
            reach = (high[everyone, step][:, None] >= low) & (low <= top)
            if not reach.any():  # intervals only move outwards and kth scores only rise
                break
            asked = np.flatnonzero((reach & (least[everyone, step][:, None] <= top)).any(1))
            asked = asked[np.argsort(step[asked], kind="stable")]
            parts = [(key, score, found)]
            for own in np.split(asked, np.flatnonzero(np.diff(step[asked])) + 1) if len(asked) else []:
                rows = slice(self.start[step[own[0]]], self.end[step[own[0]]])
                got, ids = products(q[own], self.x[rows]), self.ids[rows]
                fits = ((self.labels[rows][None] == q_labels[own][:, None]) == same) & (ids[None] != q_ids[own][:, None])
                for j in range(w):
                    r, c = np.nonzero(fits & (got >= low[own, j][:, None]) & (got <= top[own, j][:, None]))
                    parts.append((own[r] * w + j, got[r, c], ids[c]))
            key, score, found = (np.concatenate(p) for p in zip(*parts))
            by = np.lexsort((found, ~score, key))  # not -score, which overflows
            key, score, found = key[by], score[by], found[by]
            rank = np.arange(len(key)) - np.searchsorted(key, key)
            kth = key[rank == k - 1]
            low[kth // w, kth % w] = np.maximum(low[kth // w, kth % w], score[rank == k - 1])
            key, score, found = key[rank < k], score[rank < k], found[rank < k]
        return key // w, key % w, score, found


HITS = "anchor_id long, win int, score long, vec_id long"


def search_units(rows: DataFrame, same: bool, k: int) -> DataFrame:
    """rows: vectors (dim, pivot, unit, asked = false, id, label, v, dist) and anchors that ask a unit (asked = true, dist: their own, size2, low, top) -> hits."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def stacked(held: list, name: str) -> np.ndarray:
            return np.concatenate([_matrix(b.column(name)) if name in ("v", "low", "top") else b.column(name).to_numpy(zero_copy_only=False) for b in held])

        def answers(unit: Unit, block: list):
            asked = {c: stacked(block, c) for c in ("id", "label", "v", "dist", "size2", "low", "top")}
            with np.errstate(all="ignore"):
                who, win, score, hit = unit.search(asked["id"], asked["label"], asked["v"], asked["dist"], asked["size2"], asked["low"], asked["top"], same, k)
            return pa.RecordBatch.from_arrays([pa.array(asked["id"][who]), pa.array(win.astype(np.int32)), pa.array(score), pa.array(hit)], names=["anchor_id", "win", "score", "vec_id"])

        def runs():
            for batch in batches:
                if batch.num_rows:
                    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "pivot", "unit", "asked")])
                    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                    for a, b in zip(cut, cut[1:]):
                        yield tuple(key[:3, a].tolist()), bool(key[3, a]), batch.slice(a, b - a)

        at, held, unit, block = None, [], None, []
        for place, asked, part in runs():
            if at != place:
                if block:
                    yield answers(unit, block)
                at, held, unit, block = place, [], None, []
            if not asked:
                held.append(part)
                continue
            if unit is None:
                unit, held = Unit(*(stacked(held, c) for c in ("id", "label", "dist", "v"))), []
            block.append(part)
            if sum(b.num_rows for b in block) >= BLOCK_ROWS:
                yield answers(unit, block)
                block = []
        if block:
            yield answers(unit, block)

    by = ["dim", "pivot", "unit"]
    return rows.repartition(*by).sortWithinPartitions(*by, "asked").mapInArrow(found, HITS)


class Search:
    """Files of vectors, their units, and the anchors' keys."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        """rows: id, label, dim, v"""
        size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        shape = rows.agg(F.count("*").alias("n"), F.max(size).alias("most2"), F.sum(F.size("v")).alias("numbers")).first()  # three numbers
        sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.pivots = Pivots([np.asarray(r["v"], float) for r in sample], min(shape["most2"] or 0.0, float(np.finfo(float).max)))
        parts = max(-(-8 * (shape["numbers"] or 0) // UNIT_BYTES), min(LEAST_UNITS, -(-shape["n"] // SMALL_UNIT)), 1)
        filed = stored(file_keys(rows, self.pivots))
        self.file = stored(filed.repartitionByRange(parts, "dim", "pivot", "dist", "id").withColumn("unit", F.spark_partition_id()))
        discard(filed)
        self.units = stored(self.file.groupBy("dim", "pivot", "unit").agg(F.min("dist").alias("first"), F.max("dist").alias("last")))
        self.anchors = self.file.where(is_anchor).select("id", "label", "dim", "v")
        self.keys = stored(anchor_keys(self.anchors, self.pivots))

    def ask(self, places: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """places (id, dim, pivot, unit, dq, size2), windows (id, low, top) -> the first k of each anchor and window in those units."""
        asked = places.join(windows, "id").join(self.anchors.select("id", "label", "v").hint("merge"), "id")
        asked = asked.select("dim", "pivot", "unit", F.lit(True).alias("asked"), "id", "label", "v", F.col("dq").alias("dist"), "size2", "low", "top")
        file = self.file.select("dim", "pivot", "unit", F.lit(False).alias("asked"), "id", "label", "v", "dist")
        # units that nobody asks stay where they are
        file = file.join(places.select("dim", "pivot", "unit").distinct(), ["dim", "pivot", "unit"], "left_semi")
        return search_units(file.unionByName(asked, allowMissingColumns=True), same, k)

    def first(self, windows: DataFrame, wins: int, same: bool, k: int) -> DataFrame:
        """windows (id, low, top: arrays of wins longs) -> anchor_id, win, rank, vec_id, score."""
        gap = F.greatest(F.lit(0.0), F.col("first") - F.col("dq"), F.col("dq") - F.col("last"))
        met = self.keys.join(self.units, ["dim", "pivot"])
        open_ = windows.where(F.exists(F.arrays_zip("low", "top"), lambda z: z["low"] <= z["top"]))
        seed = met.where("nearest").join(open_.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("dim", "pivot", "unit", "dq", "size2"), F.struct(gap, "unit")).alias("s"))
        seed = stored(seed.select("id", "s.*"))
        near = stored(self.ask(seed, open_, same, k))
        # the kth scores of the first units narrow the windows
        order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
        kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        known = kth.groupBy(F.col("anchor_id").alias("id")).agg(*(F.max(F.when(F.col("win") == j, F.col("score"))).alias(f"k{j}") for j in range(wins)))
        better = F.array(*(F.greatest(F.col("low")[j], F.col(f"k{j}")) for j in range(wins)))
        narrow = open_.join(known, "id", "left").select("id", better.alias("low"), "top")
        spans = F.filter(F.arrays_zip("low", "top"), lambda z: z["low"] <= z["top"])
        reach = narrow.select("id", F.array_min(F.transform(spans, lambda z: z["low"])).alias("least"), F.array_max(F.transform(spans, lambda z: z["top"])).alias("most"))
        margin = 1e-9 * (F.abs("size2") + gap * gap) + 1e-6
        far = F.col("dq") + F.col("last")
        high, low = (F.col("size2") - gap * gap) / 2 + margin, (F.col("size2") - far * far) / 2 - margin - 1e-9 * far * far
        unsure = ~(F.col("size2") < float("inf")) | ~(far < float("inf"))
        ring = met.join(reach, "id").where(unsure | (high >= F.col("least")) & (low <= F.col("most"))).join(seed.select("id", "pivot", "unit"), ["id", "pivot", "unit"], "left_anti")
        rest = stored(self.ask(stored(ring.select("id", "dim", "pivot", "unit", "dq", "size2")), narrow, same, k))
        both = near.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return both.select("anchor_id", "win", "rank", "vec_id", "score")


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, least: int = 80, scale: float = 256.0) -> DataFrame:
    """vectors (vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on id. A negative's score is at least `least` percent (up to 100) of the positive's and at most that.
    """
    d = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"), scale))
    d = d.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: whole(x, scale)).alias("v"))
    d = stored(d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", F.size("r.v").alias("dim"), "r.v"))
    s = Search(d, is_anchor)
    discard(d)

    free = s.anchors.select("id", F.array(F.lit(FREE)).alias("low"), F.array(F.lit(MOST_LONG)).alias("top"))
    positives = stored(s.first(free, 1, True, k_positive))
    # the least whole score of a window: no score is both under 0 and at least its own share
    p = F.col("score")
    under = F.when(p >= 0, least * F.expr("score div 100") + F.ceil(least * (p % 100) / 100)).otherwise(MOST_LONG)
    of = positives.select(F.col("anchor_id").alias("id"), (F.col("rank") - 1).alias("win"), under.cast("long").alias("low"), p.alias("top"))
    each = lambda c, none: F.array(*(F.coalesce(F.max(F.when(F.col("win") == j, F.col(c))), F.lit(none)) for j in range(k_positive)))
    windows = stored(of.groupBy("id").agg(each("low", MOST_LONG).alias("low"), each("top", FREE).alias("top")))
    negatives = s.first(windows, k_positive, False, k_negative)
    pairs = positives.select("anchor_id", (F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"))
    out = negatives.join(pairs, ["anchor_id", "win"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
