"""Exact top-k inner-product search by ball trees, one per shard.

Vectors are dealt by hash into shards of bounded bytes; each shard builds a ball tree once a pass (a node splits where
its vectors' projection on the line between two far points has its median, down to leaves of `LEAF` vectors), and the
queries stream past it in blocks, so a task holds one shard and one block. In a shard, no vector of a node with centre
c and radius r has more than q.c + |q| r for a query q. A block descends the tree level by level, dropping nodes whose
bound is under the query's kth score; then each query visits the leaves it kept in order of their bounds until the
bound is under its kth score. The kth score is shared: a first pass over each query's best leaf in every shard gives
lower bounds, of which the greatest goes to all shards for the second pass.

Components turn into integers floor(scale * x) in double arithmetic. Bounds carry a margin for rounding; scores are
exact, in double where all products are under 2**53, else in Python integers. A score beyond the range of a long takes
the end of that range.

Rows: vectors that are null, empty or hold a null or non-finite component (before or after scaling) take no part,
neither do rows without an id.
A query meets vectors of its own length only. Rows that share an id are each a query and a candidate, never of their own
id, and equal (query_id, vec_id, score) count once; ties of score go to the smaller id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import discard, stored

SCALE = 256.0
LEAF = 64
#: Bytes of a shard's vectors and rows of a block of queries, about, at most; they bound a task.
SHARD_BYTES, BLOCK_ROWS = 32_000_000, 1024
MOST_LONG = 2**63 - 1
#: So many shards at least, of so many vectors each.
LEAST_SHARDS, SMALL_SHARD = 32, 256
#: Up to so many different vector lengths, a table with a row for each is broadcast.
MOST_LENGTHS = 10_000


def usable(vector: Column, scale: float = SCALE) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))


def whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a double; from 2**53 on a double is whole."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def build(x: np.ndarray, leaf: int = LEAF) -> list[tuple[int, int, np.ndarray, float, int, int]]:
    """Nodes (start, end, centre, radius, left child, right child; children -1 at a leaf) over an order of rows, and that order."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = x[order[start:end]]
        centre = own.mean(0)
        nodes.append([start, end, centre, float(np.sqrt(((own - centre) ** 2).sum(1).max())), -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = len(nodes) - 1
        if end - start > leaf:
            far = own[((own - centre) ** 2).sum(1).argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            cut = np.argsort(own @ (other - far), kind="stable")
            order[start:end] = order[start:end][cut]
            middle, at = (start + end) // 2, len(nodes) - 1
            todo += [(start, middle, at, 0), (middle, end, at, 1)]
    return nodes, order


class Tree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        nodes, order = build(x)
        self.ids, self.x = ids[order], x[order]
        self.start, self.end, self.left, self.right = (np.asarray([n[i] for n in nodes]) for i in (0, 1, 4, 5))
        self.centre, self.radius = np.stack([n[2] for n in nodes]), np.asarray([n[3] for n in nodes])
        # scores are sums of that many integers: exact in double
        self.exact = lambda q: float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        size = np.sqrt((q * q).sum(1))
        b = q @ self.centre[nodes].T + size[:, None] * self.radius[nodes]
        b = np.where(np.isnan(b), np.inf, np.maximum(b, -(2.0**63)))  # out of range: no bound; no score is under a long's
        return b + 1e-9 * (np.abs(b) + size[:, None] * (self.radius[nodes] + np.sqrt((self.centre[nodes] ** 2).sum(1)))) + 1e-6

    def scores(self, q: np.ndarray, rows: slice) -> np.ndarray:
        if self.exact(q):
            return self.x[rows] @ q
        return np.asarray([max(-MOST_LONG - 1, min(MOST_LONG, sum(int(a) * int(b) for a, b in zip(r, q)))) for r in self.x[rows]], object)

    def leaves(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that some query of the block may need, and all bounds (-inf where a query has dropped the leaf)."""
        level, alive = np.zeros(1, np.int64), np.ones((len(q), 1), bool)
        ends, kept = [], []
        while len(level):
            b = self.bounds(q, level)
            alive &= b >= floor[:, None]
            leaf = self.left[level] < 0
            ends.append(level[leaf])
            kept.append(np.where(alive[:, leaf], b[:, leaf], -np.inf))
            inner = np.flatnonzero(~leaf & alive.any(0))
            level, alive = np.concatenate([self.left[level[inner]], self.right[level[inner]]]), np.concatenate([alive[:, inner]] * 2, 1)
        return np.concatenate(ends), np.concatenate(kept, 1)

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, first_only: bool) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query, its k best (score, id) here, none needed under its floor; of its best leaf only, if first_only."""
        ends, bounds = self.leaves(q, floor)
        order = np.argsort(-bounds, 1, kind="stable")
        yield from (self._together if self.exact(q) else self._each)(q_ids, q, k, floor, order[:, :1] if first_only else order, ends, bounds)

    def _together(self, q_ids, q, k, floor, order, ends, bounds):
        """Round j takes every query's jth best leaf; queries at one leaf are scored in one product."""
        low, asked, score, found = floor.copy(), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for leaf in order.T:
            b = bounds[np.arange(len(q)), leaf]
            alive = np.flatnonzero((b >= low) & (b > -np.inf))
            if not len(alive):  # bounds only fall and kth scores only rise
                break
            alive = alive[np.argsort(leaf[alive], kind="stable")]
            parts = [(asked, score, found)]
            for own in np.split(alive, np.flatnonzero(np.diff(leaf[alive])) + 1):
                rows = slice(self.start[ends[leaf[own[0]]]], self.end[ends[leaf[own[0]]]])
                got, ids = q[own] @ self.x[rows].T, self.ids[rows]
                r, c = np.nonzero((got >= low[own, None]) & (ids != q_ids[own, None]))
                parts.append((own[r], got[r, c], ids[c]))
            asked, score, found = (np.concatenate(p) for p in zip(*parts))
            by = np.lexsort((found, -score, asked))
            asked, score, found = asked[by], score[by], found[by]
            new = np.append(True, (np.diff(asked) != 0) | (np.diff(score) != 0) | (np.diff(found) != 0))[: len(asked)]
            asked, score, found = asked[new], score[new], found[new]
            rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
            kth = rank == k - 1
            low[asked[kth]] = np.maximum(low[asked[kth]], score[kth])
            asked, score, found = asked[rank < k], score[rank < k], found[rank < k]
        for i, s, f in zip(asked.tolist(), score.astype(np.int64).tolist(), found.tolist()):
            yield i, [(s, f)]

    def _each(self, q_ids, q, k, floor, order, ends, bounds):
        """Query by query, with Python integers where double is not exact."""
        for i in range(len(q)):
            best: set[tuple[int, int]] = set()
            low = floor[i]
            for j in order[i]:
                if bounds[i, j] < low or bounds[i, j] == -np.inf:
                    break
                rows = slice(self.start[ends[j]], self.end[ends[j]])
                got, ids = self.scores(q[i], rows), self.ids[rows]
                best |= {(int(got[o]), int(ids[o])) for o in np.flatnonzero((ids != q_ids[i]) & (got >= low))}
                best = set(sorted(best, key=lambda s: (-s[0], s[1]))[:k])
                if len(best) == k:
                    kth = float(min(s for s, _ in best))
                    low = max(low, kth - abs(kth) * 1e-12 if abs(kth) >= 2**53 else kth)
            yield i, sorted(best, key=lambda s: (-s[0], s[1]))


def _vectors(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of record batches of one vector length"""
    return np.concatenate([r.column("id").to_numpy() for r in rows]), np.concatenate([r.column("v").flatten().to_numpy().reshape(r.num_rows, -1) for r in rows])


def search_shards(rows: DataFrame, k: int, first_only: bool) -> DataFrame:
    """rows (dim, part, asked, id, v, low): the vectors of each shard, and its queries (asked) with what their kth score is at least -> each query's best."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answers(tree: Tree, block: list) -> pa.RecordBatch:
            q_ids, qs = _vectors(block)
            floor = np.concatenate([r.column("low").fill_null(-np.inf).to_numpy(zero_copy_only=False) for r in block])
            with np.errstate(all="ignore"):
                out = [(int(q_ids[i]), s, c) for i, best in tree.search(q_ids, qs, k, floor, first_only) for s, c in best]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["query_id", "score", "vec_id"])

        def runs():
            for batch in batches:
                if batch.num_rows:
                    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "part", "asked")])
                    cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                    for a, b in zip(cut, cut[1:]):
                        yield tuple(key[:, a].tolist()), batch.slice(a, b - a)

        shard, held, tree, block = None, [], None, []
        for (dim, part, asked), rows in runs():
            if shard != (dim, part):
                if block:
                    yield answers(tree, block)
                shard, held, tree, block = (dim, part), [], None, []
            if not asked:
                held.append(rows)
                continue
            if tree is None:
                with np.errstate(all="ignore"):
                    tree, held = Tree(*_vectors(held)), []
            block.append(rows)
            if sum(r.num_rows for r in block) >= BLOCK_ROWS:
                yield answers(tree, block)
                block = []
        if block:
            yield answers(tree, block)

    dealt = rows.repartition("dim", "part").sortWithinPartitions("dim", "part", "asked")
    return dealt.mapInArrow(found, "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = SCALE) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score."""

    def scaled(df: DataFrame) -> DataFrame:
        d = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), scale))
        return d.select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: whole(x, scale)).alias("v"))

    v, q = stored(scaled(vectors)), stored(scaled(queries))
    counts = v.groupBy("dim").agg(F.count("*").alias("n"))  # a few rows
    n_parts = F.greatest(F.ceil(8 * F.col("n") * F.col("dim") / SHARD_BYTES), F.least(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / SMALL_SHARD))).cast("int")
    parts = counts.select("dim", n_parts.alias("n_parts"))
    if counts.count() <= MOST_LENGTHS:
        parts = F.broadcast(parts)
    shards = v.join(parts, "dim").select("dim", F.pmod(F.xxhash64("id"), "n_parts").cast("int").alias("part"), F.lit(False).alias("asked"), "id", "v", F.lit(None).cast("double").alias("low"))

    def answers(q: DataFrame, first_only: bool) -> DataFrame:
        # each query once for each shard of its length
        asked = q.join(parts, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.lit(True).alias("asked"), "id", "v", "low")
        return stored(search_shards(shards.unionByName(asked), k, first_only))

    best = F.slice(F.sort_array(F.collect_set(F.struct("score", (-F.col("vec_id")).alias("other"))), asc=False), 1, k)
    seen = answers(q.withColumn("low", F.lit(None).cast("double")), True)
    # of rows that share an id the smaller kth score holds, so that no row of theirs loses a partner
    kth = F.col("best")[k - 1]["score"]
    lows = seen.groupBy("query_id").agg(best.alias("best")).where(F.size("best") == k).select(F.col("query_id").alias("id"), F.when(F.abs(kth.cast("double")) < 2.0**53, kth.cast("double")).otherwise(kth.cast("double") - F.abs(kth.cast("double")) * 1e-12).alias("low"))
    single = q.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    hits = answers(q.join(lows.join(single, "id", "left_semi"), "id", "left"), False)
    discard(seen, v, q)
    ranked = hits.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), (-F.col("hit.other")).alias("vec_id"), F.col("hit.score").alias("score"))
