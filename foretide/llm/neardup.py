"""Near-duplicate documents by MinHash with one permutation, banded buckets and star-shaped candidate edges.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of
five words (the whole sequence where it has fewer words; nothing without words). Documents with equal sets form a
class, and one representative (the smallest id) goes on. A representative's signature has one minimum for each of
`BINS` bins of one permutation of its shingles; an empty bin takes the value of a full one by optimal densification
(bins tried in an order of hashes that is the same for every document). Bands of `ROWS` bins are buckets. Each bucket
gives a star: its members are linked to its smallest. Edges that signatures and set sizes make hopeless go, the rest
are confirmed on full sets. As two members of a bucket can be alike and both unlike its centre, the members of different
components in one bucket are then compared on full sets, in blocks of bounded bytes; a block gives the links that join
its components, never more than its members. Components follow by spreading the least label with pointer jumping.

A pair at the threshold shares no bucket with probability (1 - 0.75**5)**48, about 2e-6, less for closer pairs.

Members of one bucket that stay unlinked are all compared with each other: where m texts share a bucket and none is a
near copy of another, that is m * m / 2 comparisons, and each text goes to as many blocks as its bucket fills.

Rows: a null text, or one without words, has an empty set, links with nothing and is kept. A row without an id links
with nothing, has no component and is kept. Rows that share an id are one document for links (repeated rows, or several
texts). Ties: the smallest id stands for a class. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import WordHash, discard, hashed, mix, rolling, stored, text_batches

SHINGLE = 5
#: Link when 100 * intersection >= SIMILAR * union.
SIMILAR = 75
ROWS, BANDS = 5, 48
BINS = ROWS * BANDS
#: Edges whose signatures agree less go: at the threshold the share of equal bins is 0.75 with a deviation of 0.028.
LEAST_AGREE = 0.58
#: Bytes of full sets in a block, about.
BLOCK = 4_000_000


def shingle_sets(texts: list[bytes | None], cache: WordHash) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = [(t or b"").lower().split() for t in texts]
    sizes = np.asarray([len(w) for w in words], np.int64)
    flat = hashed([w for ws in words for w in ws], cache)
    grams = mix(rolling(flat, SHINGLE))
    out, start = [], 0
    for n in sizes.tolist():
        if n >= SHINGLE:
            out.append(np.unique(grams[start : start + n - SHINGLE + 1]))
        elif n:
            out.append(mix(rolling(flat[start : start + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, 0 of an empty one."""
    sizes = np.asarray([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(some):
        flat, at = np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        d1[some], d2[some] = np.add.reduceat(mix(flat), at), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
    return d1, d2


_TRIES: list[np.ndarray] = []


def _tried(t: int) -> np.ndarray:
    """The bin that each bin looks at in its try t."""
    while len(_TRIES) <= t:
        n = np.arange(BINS, dtype=np.uint64) + np.uint64(len(_TRIES) * BINS + 1)
        _TRIES.append((mix(n) % np.uint64(BINS)).astype(np.int64))
    return _TRIES[t]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte for each bin of each set; zeros for an empty set."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full((len(sets), BINS), none)
    sizes = np.asarray([len(s) for s in sets])
    if sizes.sum():
        flat = np.concatenate(sets)
        place = np.repeat(np.arange(len(sets)) * BINS, sizes) + ((flat >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(table.ravel(), place, mix(flat ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1))
    empty = table == none
    rows, cols = np.nonzero(empty & (sizes > 0)[:, None])
    filled, t = table.copy(), 0
    while len(rows):
        source = _tried(t)[cols]
        ok = ~empty[rows, source]
        filled[rows[ok], cols[ok]] = table[rows[ok], source[ok]]
        rows, cols, t = rows[~ok], cols[~ok], t + 1
    out = (filled & np.uint64(0xFF)).astype(np.uint8)
    out[sizes == 0] = 0
    return out


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def sign(docs: DataFrame) -> DataFrame:
    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = WordHash()
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), cache)
            d1, d2 = digests(sets)
            sigs = [s.tobytes() for s in signatures(sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNED)


def buckets(reps: DataFrame) -> DataFrame:
    """reps (rep, n_shingles, sig) -> rep, n_shingles, bucket for each band."""
    bands = reps.select("rep", "n_shingles", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return bands.select("rep", "n_shingles", F.xxhash64("band", F.expr(f"substring(sig, band * {ROWS} + 1, {ROWS})")).alias("bucket"))


def agree(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """The edges (a, b) whose sizes and signatures leave the similarity within reach, with the size of b."""
    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b", "n_b"]).filter(pa.array((a == b).mean(1) >= LEAST_AGREE))

    # merge joins at every size: neither side has a bound
    e = edges.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    e = e.where(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
    return e.select("a", "b", "n_b", "sig_a", "sig_b").mapInArrow(near, "a long, b long, n_b long").groupBy("a", "b").agg(F.max("n_b").alias("n_b"))


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set (its hashes as bytes) of the documents in ids (doc_id), one row for each text."""
    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = WordHash()
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set"])

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(made, "doc_id long, set binary")


def link(comp: np.ndarray, sets: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of components that sets of the first and of the other side (of one side, if all are first) link, none that follows from others."""
    sizes = np.asarray([len(s) for s in sets])
    sides = [np.flatnonzero(first), np.flatnonzero(~first)] if not first.all() else [np.arange(len(sets))] * 2
    few, many = sorted(sides, key=len)
    if not len(few) or len(np.unique(comp)) < 2:
        return []
    # shingles of one set only meet nothing
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, met = np.repeat(np.arange(len(sets)), sizes), count[number] > 1
    owner, number = owner[met], number[met]
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    shared = [number[a:b] for a, b in zip(start, start[1:])]
    many = many[np.argsort(sizes[many], kind="stable")]
    ordered, flat = sizes[many], np.concatenate([shared[i] for i in many])
    ends = np.cumsum([0, *(len(shared[i]) for i in many)])
    root, mark, out = comp.copy(), np.zeros(len(count), np.int8), []
    for i in few:
        low, high = np.searchsorted(100 * ordered, SIMILAR * sizes[i]), np.searchsorted(SIMILAR * ordered, 100 * sizes[i], "right")
        if low == high or (root[many[low:high]] == root[i]).all():
            continue
        mark[shared[i]] = 1
        both = np.append(0, np.cumsum(mark[flat[ends[low] : ends[high]]], dtype=np.int64))[ends[low : high + 1] - ends[low]]
        both = both[1:] - both[:-1]
        mark[shared[i]] = 0
        for j in many[low:high][100 * both >= SIMILAR * (sizes[i] + ordered[low:high] - both)]:
            if root[j] != root[i]:
                out.append((int(comp[i]), int(comp[j])))
                root[root == root[j]] = root[i]
    return out


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (bucket, x, y, mine, rep, comp), sets (doc_id, set) -> links (a, b) of components between the sides mine = x and mine = y of each (bucket, x, y)."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def runs(held):
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "x", "y")])
            return np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1)

        def edges(held, starts):
            comp, x, mine = (held.column(c).to_numpy() for c in ("comp", "x", "mine"))
            sets = [np.frombuffer(s, np.uint64) for s in held.column("set").to_pylist()]
            got = [e for p, q in zip(starts, np.append(starts[1:], held.num_rows)) for e in link(comp[p:q], sets[p:q], mine[p:q] == x[p:q])]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            starts = runs(held) if held.num_rows else []
            if len(starts) > 1:
                yield edges(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield edges(held, runs(held))

    each = rows.join(sets.select(F.col("doc_id").alias("rep"), "set").hint("merge"), "rep").select("bucket", "x", "y", "mine", "comp", "set")
    return each.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(found, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """edges (a, b, n_b) -> rows for links: each centre a beside its members, in blocks."""
    some = edges.groupBy("a").agg(F.ceil(F.sum(8 * F.col("n_b") + 64) / BLOCK).alias("blocks"))
    centre = some.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y")).select(F.col("a").alias("bucket"), "y", F.lit(-1).cast("long").alias("mine"), F.col("a").alias("rep"))
    member = edges.join(some, "a").withColumn("y", F.pmod(F.xxhash64("b"), F.col("blocks"))).select(F.col("a").alias("bucket"), "y", F.col("y").alias("mine"), F.col("b").alias("rep"))
    return centre.unionByName(member).select("bucket", F.lit(-1).cast("long").alias("x"), "y", "mine", "rep", F.col("rep").alias("comp"))


def blocks(placed: DataFrame) -> DataFrame:
    """placed (rep, n_shingles, bucket, comp) -> rows for links, of buckets of several components.

    x and y are a pair of blocks to be compared; mine is the block of the row. Blocks of the largest component are not
    paired with each other, so a few strangers in a large bucket cost as many rows as it has members.
    """
    comps = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles") + 64).alias("bytes"))
    mixed = comps.groupBy("bucket").agg(F.max_by(F.struct("comp", "bytes"), F.struct("n", "comp")).alias("main"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    # the star has compared the two members of a bucket of two
    mixed = stored(mixed.where("low != high AND n > 2").select("bucket", F.col("main.comp").alias("main"), F.ceil(F.col("main.bytes") / BLOCK).alias("bg"), F.ceil((F.col("bytes") - F.col("main.bytes")) / BLOCK).alias("br")))
    at = placed.join(mixed.hint("merge"), "bucket").withColumn("in_main", F.expr("comp = main"))
    at = at.withColumn("mine", F.expr("CASE WHEN in_main THEN pmod(xxhash64(rep), bg) ELSE bg + pmod(xxhash64(rep), br) END"))
    at = at.withColumn("other", F.explode(F.expr("CASE WHEN in_main THEN sequence(bg, bg + br - 1) ELSE sequence(0L, bg + br - 1) END")))
    return at.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep", "comp")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, comp: the least node reachable; nodes without a link are left out."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        heard = both.join(label.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp")
        jump = label.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp").select("node", F.col("further").alias("comp"))
        told = label.withColumn("before", F.col("comp")).unionByName(heard.unionByName(jump), allowMissingColumns=True)
        moved = stored(told.groupBy("node").agg(F.min("comp").alias("comp"), F.max("before").alias("before")))
        discard(label)
        label = moved
        if moved.where("comp != before").isEmpty():
            discard(both)
            return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    signed = stored(sign(docs))
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    # rows that share an id but not a set are one document: a star from the id's least representative to all its others
    own = some.join(reps.select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"]).select("doc_id", "rep")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("doc_id", "a")
    same_id = own.join(several, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    centres = stored(buckets(reps).groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("bucket", "a"))
    # the places of representatives in buckets that are shared; later steps read these only
    members = stored(buckets(reps).join(centres.hint("merge"), "bucket"))
    discard(centres)
    edges = stored(agree(members.where("rep != a").select("a", F.col("rep").alias("b")).distinct(), reps))
    # full sets of all that links and blocks compare, so that texts are dealt out once: blocks read buckets of more than two
    crowded = members.groupBy("bucket").count().where("count > 2").select("bucket")
    ids = edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id")))
    ids = ids.unionByName(members.join(crowded.hint("merge"), "bucket", "left_semi").select(F.col("rep").alias("doc_id"))).distinct()
    sets = stored(full_sets(docs.where("doc_id IS NOT NULL"), ids.hint("merge")))
    # stored, as components reads its links in both directions
    starred = stored(same_id.unionByName(links(stars(edges), sets)))
    label = components(starred)
    discard(starred)

    placed = members.join(label.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "n_shingles", "bucket", F.coalesce("comp", "rep").alias("comp"))
    placed = stored(placed)
    rows = stored(blocks(placed))
    blocked = stored(links(rows, sets))
    joined = components(blocked)
    discard(blocked)
    discard(members, edges, placed, rows)

    whole = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "rep").alias("node"))
    classed = whole.join(joined, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(classed, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
