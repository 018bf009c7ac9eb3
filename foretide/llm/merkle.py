"""Merkle manifest of a data set: a digest for each row, a tree for each source, a tree over the sources, and proofs.

The leaf of a row is the SHA-256 of its fields, each with its byte count in front; hashing stays in built-in functions.
In a tree every `ARITY` consecutive nodes become the SHA-256 of their digests, one after the other, until one is left.

The tree is an associative monoid. A fragment is a set of unresolved nodes (tree, level, index) -> digest; two fragments
merge by union, and whenever a run of siblings, whose number is known from the size of the tree, is complete it becomes
its parent (`resolve`). What is left does not depend on the order of merging. Leaves are sorted by source and id over all
tasks and cut into chunks of `CHUNK`; a chunk leaves a few nodes at its two ends for each level. `tree_reduce` merges
fragments `FAN` at a time; the nodes it makes are rows of a table, as they are needed for proofs, and only chunk numbers
and the number of sources reach the driver. Each chunk then makes its own nodes again, gets the few nodes beside it by a
join, and hashes and checks the proofs of its rows.

Rows: null fields are `-`. Rows of a null source are a source of their own, before the others; rows of a null id come
first, are never tampered with, and rows that share an id follow each other by leaf. Repeated rows are leaves each.
Texts are hashed whole. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm.common import discard, stored

ARITY = 3
#: Leaves of a chunk, partitions of the sort at most, fragments that are merged at once.
CHUNK, MOST_PARTS, FAN = 20_000, 4096, 64
#: The tree over the sources.
TOP = -1

Nodes = dict[tuple[int, int, int], str]


def digest_of(*columns: Column) -> Column:
    """SHA-256 of the columns: `-` for a null, else byte count, colon and value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(n: int, level: int, arity: int = ARITY) -> int:
    """Nodes at a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


def resolve(nodes: Nodes, sizes: dict[int, int], arity: int = ARITY) -> tuple[Nodes, Nodes]:
    """What is left of a fragment once all complete runs have become parents, and the parents made.

    sizes: leaves of each tree. The last node of a source's tree becomes the source's leaf in the tree over the sources.
    """
    left, made, widths = dict(nodes), {}, {}
    runs = {(t, level, i // arity) for t, level, i in left}
    while runs:
        above = set()
        for t, level, run in runs:
            if (t, level) not in widths:
                widths[t, level] = width(sizes[t], level, arity)
            n = widths[t, level]
            if n == 1:
                if t == TOP:
                    continue
                key, digest = (TOP, 0, t), left.pop((t, level, 0))
            else:
                members = [(t, level, i) for i in range(run * arity, min(n, (run + 1) * arity))]
                if not all(m in left for m in members):
                    continue
                key, digest = (t, level + 1, run), joined([left.pop(m) for m in members])
            left[key] = made[key] = digest
            above.add((key[0], key[1], key[2] // arity))
        runs = above
    return left, made


def beside(t: int, first: int, end: int, whole: tuple[int, int], n: int, arity: int = ARITY) -> Iterator[tuple[int, int, int]]:
    """The nodes that proofs of the leaves [first, end) of a tree need and that the leaves [whole) don't make."""
    span, level = 1, 0
    while True:
        wide = width(n, level, arity)
        low, high = first // span // arity * arity, min(wide, ((end - 1) // span // arity + 1) * arity)
        near = range(low, high) if high - low <= 4 * arity else [*range(low, low + 2 * arity), *range(high - 2 * arity, high)]
        for i in near:
            if i * span < whole[0] or min(n, (i + 1) * span) > whole[1]:
                yield t, level, i
        if wide == 1:
            return
        span, level = span * arity, level + 1


class Proofs:
    """Proofs of leaves, from all nodes beside their paths."""

    def __init__(self, known: Nodes, sizes: dict[int, int], arity: int = ARITY):
        self.known, self.sizes, self.arity, self.seen, self.widths = known, sizes, arity, {}, {}

    def step(self, t: int, level: int, i: int) -> tuple[list[str], list[str], tuple[int, int, int] | None]:
        """The siblings before and after a node, and its parent (none above the root)."""
        if (t, level) not in self.widths:
            self.widths[t, level] = width(self.sizes[t], level, self.arity)
        n = self.widths[t, level]
        if n == 1:
            return [], [], None if t == TOP else (TOP, 0, t)
        run = i // self.arity
        before = [self.known[t, level, j] for j in range(run * self.arity, i)]
        after = [self.known[t, level, j] for j in range(i + 1, min(n, (run + 1) * self.arity))]
        return before, after, (t, level + 1, run)

    def siblings(self, node: tuple[int, int, int] | None) -> str:
        """The digests of all siblings from a node up to the root."""
        if node is None:
            return ""
        if node not in self.seen:
            before, after, up = self.step(*node)
            text = "".join(before + after) + self.siblings(up)
            if not node[1]:
                return text
            self.seen[node] = text
        return self.seen[node]

    def fold(self, node: tuple[int, int, int], digest: str) -> str:
        """The root that a digest at a node leads to."""
        while True:
            before, after, up = self.step(*node)
            if up is None:
                return digest
            if up[0] == node[0]:
                digest = joined([*before, digest, *after])
            node = up


def dealt(leaves: DataFrame) -> DataFrame:
    """leaves (doc_id, source, leaf, other, tie) -> the same with chunk and pos, chunks in the order of source, id and leaf."""
    parts = max(1, min(MOST_PARTS, -(-leaves.count() // CHUNK)))
    by = ["source", "doc_id", "leaf", "tie"]
    ordered = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = 0
        for batch in batches:
            pos = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            chunk = batch.column("part").to_numpy().astype(np.int64) << 32 | pos // CHUNK
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "leaf", "other")), pa.array(chunk), pa.array(pos)], names=["doc_id", "source", "leaf", "other", "chunk", "pos"])

    kinds = dict(leaves.dtypes)
    return ordered.mapInArrow(cut, f"doc_id {kinds['doc_id']}, source string, leaf string, other string, chunk long, pos long")


def runs_of(rows: DataFrame) -> DataFrame:
    """rows (chunk, source) -> chunk, source, tree, first, n: which leaves of which tree a chunk holds, and chunks numbered from 0 (place)."""
    counts = rows.groupBy("chunk", "source").agg(F.count("*").alias("m"))
    of = Window.partitionBy("source")
    before = F.coalesce(F.sum("m").over(of.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("chunk", "source", "m", before.alias("first"), F.sum("m").over(of).alias("n"), (F.col("chunk") == F.min("chunk").over(of)).cast("long").alias("starts"))
    # sources that start in the chunks before: a row for each chunk
    order = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = counts.groupBy("chunk").agg(F.sum("starts").alias("starts"))
    each = each.select("chunk", F.coalesce(F.sum("starts").over(order), F.lit(0)).alias("earlier"), (F.row_number().over(Window.orderBy("chunk")) - 1).cast("long").alias("place"))
    inside = F.sum("starts").over(Window.partitionBy("chunk").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("tree", F.when(F.col("starts") == 1, inside)).join(each, "chunk").withColumn("tree", F.col("earlier") + F.col("tree") - 1)
    return placed.select("chunk", "place", "source", F.max("tree").over(of).alias("tree"), "first", "m", "n")


NODE = "place long, tree long, level int, i long, n long, digest string"


def _table(rows: list[tuple], schema: str):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _leaves_of(rows: list[dict], runs: list[dict]) -> tuple[dict[int, int], list[tuple[int, int, int]], list[dict]]:
    """Sizes of trees, and the leaves' nodes in order, with their rows."""
    at = {r["source"]: [r["tree"], r["first"]] for r in runs}
    nodes = []
    for r in rows:
        run = at[r["source"]]
        nodes.append((run[0], 0, run[1]))
        run[1] += 1
    return {r["tree"]: r["n"] for r in runs}, nodes, rows


def _split(table) -> tuple[list[dict], list[dict], list[dict]]:
    """A chunk's leaves by position, runs and nodes."""
    rows = table.to_pylist()
    return sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["pos"]), [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 2]


def fragments(rows: DataFrame, sources: int) -> DataFrame:
    """Each chunk's unresolved nodes."""

    def local(table):
        leaves, runs, _ = _split(table)
        sizes, nodes, leaves = _leaves_of(leaves, runs)
        sizes[TOP] = sources
        left, _ = resolve({k: r["leaf"] for k, r in zip(nodes, leaves)}, sizes)
        place = runs[0]["place"]
        return _table([(place, *k, sizes[k[0]], d) for k, d in left.items()], NODE)

    return rows.groupBy("chunk").applyInArrow(local, NODE)


def tree_reduce(parts: DataFrame, last: int, sources: int) -> DataFrame:
    """parts (place, tree, level, i, n, digest): fragments in places 0 to last -> all nodes that any merge left or made."""
    both = f"{NODE}, remains boolean"

    def merged(table):
        rows = table.to_pylist()
        sizes = {r["tree"]: r["n"] for r in rows} | {TOP: sources}
        left, made = resolve({(r["tree"], r["level"], r["i"]): r["digest"] for r in rows}, sizes)
        place = rows[0]["place"]
        return _table([(place, *k, sizes[k[0]], d, k in left) for k, d in {**left, **made}.items()], both)

    nodes = parts
    while last > 0:
        last //= FAN
        done = stored(parts.withColumn("place", F.floor(F.col("place") / FAN)).groupBy("place").applyInArrow(merged, both))
        nodes = nodes.unionByName(done.drop("remains"))
        parts = done.where("remains").drop("remains")
    return nodes.select("tree", "level", "i", "n", "digest")


def wanted(runs: DataFrame, sources: int) -> DataFrame:
    """chunk, tree, level, i: the nodes each chunk needs and doesn't make."""
    schema = "chunk long, tree long, level int, i long"

    def ends(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["tree"])
        out, chunk = [], rows[0]["chunk"]
        for r in rows:
            if r["m"] < r["n"]:
                out += beside(r["tree"], r["first"], r["first"] + r["m"], (r["first"], r["first"] + r["m"]), r["n"])
        low, high = rows[0]["tree"], rows[-1]["tree"] + 1
        # only the first and the last source of a chunk can go on in another
        whole = (low + (rows[0]["m"] < rows[0]["n"]), high - (rows[-1]["m"] < rows[-1]["n"]))
        out += beside(TOP, low, high, whole, sources)
        return _table([(chunk, *k) for k in out], schema)

    return runs.groupBy("chunk").applyInArrow(ends, schema)


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (doc_id, source, leaf, other: a leaf to be checked in its place, or null) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    once = stored(leaves.select("doc_id", "source", "leaf", "other", F.monotonically_increasing_id().alias("tie")))
    rows = stored(dealt(once))
    discard(once)
    runs = stored(runs_of(rows))
    sizes = runs.agg(F.max("place").alias("last"), F.max("tree").alias("tree")).first()  # two numbers
    last, sources = (sizes["last"], sizes["tree"] + 1) if sizes["last"] is not None else (0, 0)
    tagged = rows.select("chunk", F.lit(0).alias("kind"), "pos", "source", "leaf").unionByName(runs.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = stored(fragments(tagged, sources))
    nodes = tree_reduce(parts, last, sources)
    near = stored(wanted(runs, sources).join(nodes.distinct().hint("merge"), ["tree", "level", "i"]))

    kind = dict(rows.dtypes)["doc_id"]
    given = rows.withColumn("kind", F.lit(0)).unionByName(runs.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(near.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def proved(table):
        import pyarrow as pa

        own, held, around = _split(table)
        sizes, nodes, own = _leaves_of(own, held)
        sizes[TOP] = sources
        made = {k: r["leaf"] for k, r in zip(nodes, own)}
        made |= resolve(made, sizes)[1]
        made |= {(r["tree"], r["level"], r["i"]): r["digest"] for r in around}
        level = 0
        while width(sources, level) > 1:
            level += 1
        proofs, root, out = Proofs(made, sizes), made[TOP, level, 0], []
        for node, r in zip(nodes, own):
            folded = proofs.fold(node, r["leaf"] if r["other"] is None else r["other"])
            proof = hashlib.sha256(proofs.siblings(node).encode()).hexdigest()
            out.append((r["leaf"], made[TOP, 0, node[0]], root, proof, folded, folded == root))
        rest = _table(out, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return rest.add_column(0, "doc_id", pa.array([r["doc_id"] for r in own], table.schema.field("doc_id").type))

    return given.groupBy("chunk").applyInArrow(proved, schema)


def document_manifest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> the manifest, checked against texts that lost their line breaks where crc32 of the id is even."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    spoilt = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")), digest_of(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    return manifest(docs.select("doc_id", "source", digest_of(*fields, F.col("text")).alias("leaf"), spoilt.alias("other")))
