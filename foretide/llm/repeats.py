"""Repeated passages, found by a compressed FM-index per shard.

A window is `WINDOW` consecutive words of one document. A word goes where a window that covers it also starts in a
document with a smaller id. The steps:

1. Where documents are read, each window picks an anchor, the leftmost least hash of its runs of 12 words, and then a
   longer run around it: of the words a window has beside the anchor, half lie before or half lie after it, so the anchor
   with that half is the key of the window. Equal windows pick equal keys, so all places of a window meet under one key.
   Consecutive windows with one key form a region. Whole copies of a text are one class and its smallest id goes on.
2. Keys that lie in one document only are dropped. Regions with equal words are one region, with its least and its
   greatest id. The words of each remaining region are read once, from its least document.
3. A key with more than `HOT` distinct regions (a passage that most documents hold, each among other words) would fill
   a shard. Its regions are halved once more by the same rule, each into two at most, under longer keys, and what lies in
   one document is dropped; the key grows to a whole window, which has one region, so this ends after six turns.
4. Regions are dealt by key into shards of bounded size. A shard builds an FM-index of its regions (suffix order by
   prefix doubling, the Burrows-Wheeler text in a wavelet tree) and streams the regions through it: backward search
   with parent steps gives each position's matching statistic, capped at the window; where it reaches the window, the
   least document id among the occurrences is reported.
5. Reported intervals go back to all documents of the region, and from there to the texts.

Rows: a null text has no words. Repeated rows, and rows that share an id, never remove each other's words, and each is
judged by its own text; a row without an id keeps all its words and is no source. Very long texts are cut nowhere. An
empty table gives no rows; extra columns are ignored. Words are compared by 64-bit hashes, texts by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import BASE, WordHash, discard, hashed, mix, rolling, stored, text_batches

WINDOW, ANCHOR = 50, 12
#: Distinct regions of a key that go to a shard as they are, and words of a shard.
HOT, SHARD_WORDS = 1024, 200_000
NONE = np.iinfo(np.int64).max


# ---- the index ----


class WaveletTree:
    """Counts of a symbol before a place; a level keeps one bit a symbol, in words of 64 with the ones before each."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        s, self.levels = symbols.astype(np.int64), []
        for b in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (s >> b) & 1
            padded = np.zeros((len(s) // 64 + 1) * 64, np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int32) - np.bitwise_count(words)
            self.levels.append((b, words, before, int((bit == 0).sum())))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.start = np.zeros(n_symbols, np.int64)
        found, first = np.unique(s, return_index=True)
        self.start[found] = first

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        i = place
        for b, words, before, zeros in self.levels:
            at = i >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i - self.start[symbol]


class Index:
    """FM-index of passages (arrays of 64-bit words), each with the id of a document."""

    def __init__(self, passages: list[np.ndarray], ids: np.ndarray, window: int = WINDOW):
        self.window = window
        sizes = np.asarray([len(p) for p in passages], np.int64)
        self.words, symbol = np.unique(np.concatenate(passages), return_inverse=True)
        # each passage ends in a separator of its own, below all words
        m, n = len(passages), int(sizes.sum()) + len(passages)
        ends = np.cumsum(sizes + 1) - 1
        text, inside = np.zeros(n, np.int64), np.ones(n, bool)
        inside[ends] = False
        text[inside], text[ends] = symbol + 1, 0
        rank = np.where(inside, text + m - 1, 0)
        rank[ends] = np.arange(m)
        ranks, h, places = [np.unique(rank, return_inverse=True)[1].astype(np.int32)], 1, np.arange(n)
        while ranks[-1].max() < n - 1:
            key = ranks[-1].astype(np.int64) * (n + 1) + ranks[-1][np.minimum(places + h, n - 1)]
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int32)
            new[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            ranks.append(new)
            h *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[ranks[-1]] = places
        lcp = np.zeros(n, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            r = ranks[level]
            lcp[1:] += (r[suffixes[1:] + lcp[1:]] == r[suffixes[:-1] + lcp[1:]]) << level
        # what stays is the wavelet tree, a byte a place of common prefixes, and the least ids
        self.n, self.lcp = n, np.minimum(lcp, window).astype(np.uint8)
        self.tree = WaveletTree(text[suffixes - 1], len(self.words) + 1)
        self.first = np.cumsum(np.append(0, np.bincount(text, minlength=len(self.words) + 1)))
        self._starts: dict[int, np.ndarray] = {}
        # the least id of each class of suffixes that share a window
        heads = self.starts(window)
        self.least = np.minimum.reduceat(np.repeat(ids, sizes + 1)[suffixes], heads[:-1])

    def starts(self, depth: int) -> np.ndarray:
        """The first rows of the classes of suffixes that share `depth` symbols, and the number of rows."""
        if depth not in self._starts:
            self._starts[depth] = np.append(np.flatnonzero(self.lcp < depth), self.n)
        return self._starts[depth]

    def widen(self, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        heads = self.starts(depth)
        k = np.searchsorted(heads, row, "right") - 1
        return heads[k], heads[k + 1]

    def search(self, queries: list[np.ndarray]) -> np.ndarray:
        """queries x (longest query): the least id with the window that starts there, NONE without one; aligned right."""
        sizes = np.asarray([len(q) for q in queries], np.int64)
        longest, n_q = int(sizes.max()), len(queries)
        flat = np.concatenate(queries)
        symbol = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        symbol = np.where(self.words[symbol] == flat, symbol + 1, 0)
        grid = np.zeros((n_q, longest), np.int64)
        grid[np.arange(longest) >= (longest - sizes)[:, None]] = symbol
        lo, hi, size = np.zeros(n_q, np.int64), np.full(n_q, self.n), np.zeros(n_q, np.int64)
        out = np.full((n_q, longest), NONE)
        for t in range(longest - 1, -1, -1):
            live = t >= longest - sizes
            whole = np.flatnonzero(live & (size == self.window))
            if len(whole):
                lo[whole], hi[whole] = self.widen(lo[whole], self.window - 1)
                size[whole] -= 1
            todo = np.flatnonzero(live)
            while len(todo):
                c = grid[todo, t]
                both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                a, b = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
                ok = (c > 0) & (a < b)
                good, bad = todo[ok], todo[~ok]
                lo[good], hi[good], size[good] = a[ok], b[ok], size[good] + 1
                # a match that can't be extended loses its last word; one of no word waits for the next position
                empty = (size[bad] <= 1) | (grid[bad, t] == 0)
                again = bad[(size[bad] > 0) & (grid[bad, t] > 0)]
                lo[bad[empty]], hi[bad[empty]], size[bad[empty]] = 0, self.n, 0
                rest = bad[~empty]
                size[rest] -= 1
                for depth in np.unique(size[rest]):
                    own = rest[size[rest] == depth]
                    lo[own], hi[own] = self.widen(lo[own], int(depth))
                todo = again
            hit = np.flatnonzero(live & (size == self.window))
            out[hit, t] = self.least[np.searchsorted(self.starts(self.window), lo[hit], "right") - 1]
        return out


# ---- regions ----


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of each `width` consecutive values."""
    best, done = np.arange(len(values)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while 2 * done <= width:
        best = lower(best[: len(best) - done], best[done:])
        done *= 2
    more = width - done
    return lower(best[: len(best) - more], best[more:]) if more else best


class Powers:
    """Powers of the base and of its inverse, as many as were ever asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(2 * n, BASE, np.uint64)
            step[0] = 1
            back = np.full(2 * n, pow(BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]


def halves(size: int) -> tuple[int, int]:
    """A window with a key of `size` words has at least so many words before it, or else at least so many after it."""
    before = (WINDOW - size + 1) // 2
    return before, WINDOW - size - before + 1


def regions(flat: np.ndarray, sizes: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Text number, key, content hash, first word in its text and number of windows of each region of texts end to end."""
    n = len(flat) - WINDOW + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = leftmost_least(mix(rolling(flat, ANCHOR)), WINDOW - ANCHOR + 1)
    before, after = halves(ANCHOR)
    left = at - np.arange(n) >= before
    ok = doc[:n] == doc[WINDOW - 1 :]
    head = ok & np.append(True, (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | ~ok[:-1])
    first = np.flatnonzero(head)
    count = np.bincount((np.cumsum(head) - 1)[ok], minlength=len(first))
    up, down = powers.of(len(flat))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(flat * up))

    def hash_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))

    key = hash_of(np.where(left, at - before, at)[first], np.where(left, ANCHOR + before, ANCHOR + after)[first])
    return doc[first], key, hash_of(first, count + WINDOW - 1), first - (np.cumsum(sizes) - sizes)[doc[first]], count


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _key(sha: str) -> int:
    """60 bits of a digest: tells texts that share an id apart."""
    return int(sha[:15], 16)


SCANNED = "doc_id long, n_words long, sha string, a array<long>, r array<long>, start array<int>, n array<int>"


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> of each row: words, digest of its words, and its regions as parallel arrays."""

    def scanned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache, powers = WordHash(), Powers()
        for batch in text_batches(batches):
            split = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.asarray([len(s) for s in split], np.int64)
            doc, a, r, start, n = regions(hashed([w for s in split for w in s], cache), sizes, powers)
            ends = pa.array(np.searchsorted(doc, np.arange(len(split) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(a.view(np.int64)), pa.array(r.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array([_digest(s) for s in split]), *lists], names=["doc_id", "n_words", "sha", "a", "r", "start", "n"])

    return docs.select("doc_id", "text").mapInArrow(scanned, SCANNED)


REGIONS = "a long, r long, low long, high long, words binary"


def region_words(texts: DataFrame) -> DataFrame:
    """texts (text, needed) -> the words of the regions needed (key, a, r, low, high, start, n) that are of that text."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = WordHash()
        for batch in text_batches(batches):
            out = []
            for text, needed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("needed").to_pylist()):
                words = (text or b"").split()
                sha = _key(_digest(words))
                if own := [x for x in needed if x["key"] == sha]:
                    words = hashed(words, cache)
                    out += [(x["a"], x["r"], x["low"], x["high"], words[x["start"] : x["start"] + x["n"] + WINDOW - 1].tobytes()) for x in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["a", "r", "low", "high", "words"])

    return texts.select("text", "needed").mapInArrow(cut, REGIONS)


HALVES = "a long, r long, at int, key long, content long, low long, high long, words binary, place int, size int"


def halved(hot: DataFrame) -> DataFrame:
    """Regions (a, r, low, high, words, place and size of the key, null at first) -> both halves: at, the first word in the region, and what a region has, under longer keys."""

    def parts(words: np.ndarray, place: int | None, size: int | None) -> Iterator[tuple[int, int, int, int]]:
        if size is None:
            anchor, size = int(leftmost_least(mix(rolling(words[:WINDOW], ANCHOR)), WINDOW - ANCHOR + 1)[0]), ANCHOR
            before, after = halves(size)
            place, size = (anchor - before, size + before) if anchor >= before else (anchor, size + after)
        before, after = halves(size)
        windows = len(words) - WINDOW + 1
        middle = max(0, min(windows, place - before + 1))  # windows before it have that much before the key
        if middle > 0:
            yield 0, middle, place - before, size + before
        if middle < windows:
            yield middle, windows, place - middle, size + after

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = np.frombuffer(r["words"], np.uint64)
                for start, end, place, size in parts(words, r["place"], r["size"]):
                    own = words[start : end + WINDOW - 1]
                    key, content = (int(mix(rolling(x, len(x)) + np.uint64(len(x))).view(np.int64)[0]) for x in (own[place : place + size], own))
                    out.append((r["a"], r["r"], start, key, content, r["low"], r["high"], own.tobytes(), place, size))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in HALVES.split(", ")])

    return hot.select("a", "r", "low", "high", "words", "place", "size").mapInArrow(made, HALVES)


FOUND = "turn int, a long, r long, at int, n int, least long"


def search_shards(pieces: DataFrame) -> DataFrame:
    """pieces (shard, turn, a, r, low, high, words) -> runs of n windows from word `at` of region (a, r) that some document below `high` holds, with the least such id."""

    def search(pdf):
        import pandas as pd

        passages = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        index = Index(passages, pdf["low"].to_numpy(np.int64))
        out = []
        for i in range(0, len(pdf), 8192):
            part, rows = passages[i : i + 8192], pdf.iloc[i : i + 8192]
            found = index.search(part)
            found[found >= rows["high"].to_numpy(np.int64)[:, None]] = NONE
            q, t = np.nonzero(found != NONE)
            if len(q):
                least = found[q, t]
                head = np.append(True, (q[1:] != q[:-1]) | (t[1:] != t[:-1] + 1) | (least[1:] != least[:-1]))
                first = np.flatnonzero(head)
                at = t[first] - (found.shape[1] - np.asarray([len(p) for p in part]))[q[first]]
                out.append(pd.DataFrame({**{c: rows[c].to_numpy()[q[first]] for c in ("turn", "a", "r")}, "at": at.astype(np.int32), "n": np.diff(np.append(first, len(q))).astype(np.int32), "least": least[first]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("turn", "a", "r", "at", "n", "least")})

    return pieces.groupBy("shard").applyInPandas(search, FOUND)


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_spans(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, spans of (key, start, n windows)) -> what is left of each text that has a span of its own."""

    def removed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches):
            out = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                words = (text or b"").split()
                key, edge = _key(_digest(words)), np.zeros(len(words) + 1, np.int64)
                own = [(x["start"], x["start"] + x["n"] + WINDOW - 1) for x in spans if x["key"] == key]
                for start, end in own:
                    edge[start] += 1
                    edge[end] -= 1
                if own:
                    keep = (np.cumsum(edge)[: len(words)] == 0).tolist()
                    left = [w for w, k in zip(words, keep) if k]
                    out.append((doc, len(words), len(words) - len(left), _digest(left)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return texts.select("doc_id", "text", "spans").mapInArrow(removed, KEPT)


def spread(regions: DataFrame) -> DataFrame:
    """regions (a, r, low, high) -> the keys a that two documents share, and whether a shard would be filled by one."""
    each = regions.groupBy("a").agg(F.count("*").alias("regions"), F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
    return stored(each.select("a", (F.col("regions") > HOT).alias("hot")))


def reported(cut: DataFrame, keys: DataFrame) -> DataFrame:
    """cut (a, r, low, high, words), keys (a, hot) -> runs of n windows from word `at` of region (a, r) with the least id below `high`."""
    none = F.lit(None).cast("int")
    level, cold, ways = cut.select("*", none.alias("place"), none.alias("size")), [], []
    while True:
        placed = level.join(keys, "a")
        cold.append(placed.where("NOT hot").select(F.lit(len(cold)).alias("turn"), "a", "r", "low", "high", "words"))
        if keys.where("hot").isEmpty():
            break
        parts = stored(halved(placed.where("hot")))
        ways.append(parts.select("a", "r", F.col("at").alias("offset"), "key", "content"))
        words = F.first(F.struct("words", "place", "size")).alias("x")  # equal words have equal places
        level = stored(parts.groupBy(F.col("key").alias("a"), F.col("content").alias("r")).agg(F.min("low").alias("low"), F.max("high").alias("high"), words).select("a", "r", "low", "high", "x.*"))
        keys = spread(level)
    pieces = cold[0]
    for more in cold[1:]:
        pieces = pieces.unionByName(more)
    pieces = stored(pieces)
    size = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0  # one number
    shards = max(1, -(-size // (8 * SHARD_WORDS)))
    found = stored(search_shards(pieces.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))))
    discard(pieces)
    out = found.where(F.col("turn") == len(ways)).drop("turn")
    for turn in range(len(ways) - 1, -1, -1):
        back = out.select(F.col("a").alias("key"), F.col("r").alias("content"), "at", "n", "least").join(ways[turn], ["key", "content"])
        out = found.where(F.col("turn") == turn).drop("turn").unionByName(back.select("a", "r", (F.col("at") + F.col("offset")).alias("at"), "n", "least"))
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(scan(docs))
    # the aggregates are stored, so that a skewed join reads its two sides from shuffles and can be split
    least = stored(scanned.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("least")))
    slim = scanned.select("doc_id", "n_words", "sha").join(least, "sha", "left")
    slim = stored(slim.select("doc_id", "n_words", "sha", F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("n_words") >= WINDOW), F.lit(False)).alias("copy")))

    # where the shared keys lie; of a copied text, in its first document only
    key = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("key")
    places = scanned.where("doc_id IS NOT NULL").select("doc_id", key, F.explode(F.arrays_zip("a", "r", "start", "n")).alias("x")).select("doc_id", "key", "x.*")
    shared = stored(places.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a"))
    copies = slim.where("copy").select("doc_id", key).distinct()
    places = stored(places.join(shared, "a").join(copies, ["doc_id", "key"], "left_anti"))
    discard(scanned, least, shared)
    each = places.groupBy("a", "r").agg(F.min(F.struct("doc_id", "start", "key", "n")).alias("x"), F.max("doc_id").alias("high"))
    each = stored(each.select("a", "r", F.col("x.doc_id").alias("low"), "high", "x.start", "x.key", "x.n"))
    keys = spread(each)
    needed = stored(each.join(keys, "a", "left_semi"))

    # the texts that hold a region still needed; later steps read no other
    listed = needed.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(F.struct("key", "a", "r", "low", "high", "start", "n")).alias("needed"))
    wanted = places.join(keys, "a", "left_semi").select("doc_id").distinct()
    texts = stored(docs.join(wanted.join(listed, "doc_id", "left"), "doc_id"))
    cut = stored(region_words(texts.where("needed IS NOT NULL")))
    discard(each, needed)

    spans = places.drop("n").join(reported(cut, keys), ["a", "r"]).where("least < doc_id").select("doc_id", "key", (F.col("start") + F.col("at")).alias("start"), "n")
    spans = stored(spans.groupBy("doc_id").agg(F.collect_set(F.struct("key", "start", "n")).alias("spans")))
    discard(places, cut)
    changed = remove_spans(texts.select("doc_id", "text").join(spans, "doc_id"))

    same = slim.withColumn("key", key).join(spans.select("doc_id", F.explode(F.array_distinct("spans.key")).alias("key")), ["doc_id", "key"], "left_anti")
    rest = same.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(F.col("copy"), _digest([])).otherwise(F.col("sha")).alias("kept_sha256"))
    return rest.unionByName(changed)
