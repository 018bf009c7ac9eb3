"""Benchmark decontamination by templates.

A text turns into template tokens: words in lower case without signs; a run of numbers and units is one <quantity> of
the dimension its last unit has (length, mass, time, money, ...; none without a unit), a run of capitalised words inside
a sentence one <name>. Windows of `WINDOW` tokens with at least `LEAST_WORDS` words
are hashed, and windows of documents joined to windows of benchmark items by hash. Matches of one document and item
that follow each other, at most `SHIFT` tokens moved from one to the next, are one alignment. It counts when it covers
at least `LEAST_COVER` of the item's windows, or as many tokens as so many windows in a row hold, or an unchanged run of
`LEAST_RUN` tokens; and when its slots are consistent: each value of the item's slots maps to one value of the document's, or most slots are
unchanged. Two values of the item may get one new value, as small numbers do by chance. So a question with other numbers
or names is caught, while a document that only shares a template's words with clashing values is not.

Document windows pass a bitmap made of the benchmark's hashes (some bits for each, up to `MOST_BITS`) before they are
joined, so that most never leave the task that reads them; whatever passes is joined exactly, whatever the size of the
benchmark. A template window that very many documents hold goes to the items that hold it by a salted key.

Items without a window (formulas, scripts without spaces) are found verbatim: their characters in lower case without
white space, and without signs at the ends, stand in a document. Two windows of a power of two characters, at the item's
start and end, cover it. A letter or digit of ASCII at an end must not go on in the document. Items of fewer than
`LEAST_BYTES` bytes of such characters ("yes", "Paris?", "42") stand in ordinary prose by chance and say nothing of a
leak; they are never searched for, and `unsearchable` lists them.

Rows: null and empty texts have no windows. An item of fewer than `WINDOW` tokens has one window of all its tokens, if
it has `LEAST_WORDS` words. Repeated rows and ids count once. Ties between alignments go to the earliest. Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import mix, rolling, stored, text_batches

WINDOW, LEAST_WORDS, LEAST_COVER = 8, 4, 0.5
#: Tokens added or removed between two neighbouring matches of an alignment at most; tokens of an unchanged run that is enough.
SHIFT, LEAST_RUN = 8, 13
#: Bytes (UTF-8) of the characters of an item that is found verbatim, at least.
LEAST_BYTES = 12
#: Bits of the bitmap, powers of two: at least, and at most (16 MB).
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 27
#: Windows of documents with one hash (or ends of verbatim items) that go to one task, about.
HOT_ROWS = 50_000

#: Words that a number before them takes into its quantity, by what they measure.
DIMENSIONS = [
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles", "mg g kg t ton tons tonne tonnes oz lb lbs pound pounds", "ml l liter liters litre litres",
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years", "percent %", "dollar dollars euro euros cent cents usd eur gbp",
    "c f k degree degrees", "hz khz mhz ghz", "w kw mw kwh v a n j kj cal kcal pa kpa bar", "mph kmh kph", "b kb mb gb tb",
]
UNITS = {u: i + 1 for i, words in enumerate(DIMENSIONS) for u in words.split()}
_NUMBER = re.compile(r"[0-9][0-9.,:/]*+([^\W\d_]{0,3}+)\Z")
_NAME = re.compile(r"[^\W\d_a-zà-öø-ÿ][a-zà-öø-ÿ]++\Z")
_SIGNS = re.compile(r"[\W_]+")
_SOME = re.compile(r"\w")
WORD, NUMBER, UNIT, NAME, NOTHING = range(5)
QUANTITY, NAMED = np.uint64(0x51A17C3D9E4B2F01), np.uint64(0x7B3E58D1C6A9F403)


def kind_of(word: str) -> tuple[int, str, int, bool]:
    """Kind, plain form, dimension (of a unit, or of a number with one), and whether a sentence ends after it; in linear time."""
    plain = _SIGNS.sub("", word).lower()
    m = _SOME.search(word)
    if not m:
        return (UNIT, "%", UNITS["%"], False) if word.strip() == "%" else (NOTHING, plain, 0, any(c in word for c in ".!?:"))
    stop = len(word) - _SOME.search(word[::-1]).start()
    core, ends = word[m.start() : stop], any(c in word[stop:] for c in ".!?:")
    if n := _NUMBER.match(core):
        return NUMBER, plain, UNITS["%"] if "%" in word[stop:] else UNITS.get(n[1].lower(), 0), ends
    if plain in UNITS:
        return UNIT, plain, UNITS[plain], ends
    return (NAME if _NAME.match(core) else WORD if plain else NOTHING), plain, 0, ends


class Tokens:
    """Words (bytes) -> index of what is known about them."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.clear(most)

    def clear(self, room: int) -> None:
        self.index: dict[bytes, int] = {}
        self.value, self.kind, self.dimension, self.ends = np.zeros(room, np.uint64), np.zeros(room, np.int8), np.zeros(room, np.int8), np.zeros(room, bool)

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        new = set(words) - self.index.keys()
        if len(self.index) + len(new) > len(self.value):
            new = set(words)
            self.clear(max(self.most, len(new)))
        for raw in new:
            at = self.index[raw] = len(self.index)
            # words of ASCII letters in lower case are most of all
            if raw.isalpha() and raw.islower() and (w := raw.decode()) not in UNITS:
                self.value[at], self.kind[at] = xxhash.xxh3_64_intdigest(raw), WORD
                continue
            kind, plain, self.dimension[at], self.ends[at] = kind_of(raw.decode())
            self.value[at], self.kind[at] = xxhash.xxh3_64_intdigest(plain), kind
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def templates(texts: list[bytes | None], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of the texts end to end: text number, hash, whether it is a slot, value."""
    split = [(t or b"").split() for t in texts]
    sizes = np.asarray([len(s) for s in split], np.int64)
    index = known.of([w for s in split for w in s])
    value, kind, dimension, ends = known.value[index], known.kind[index], known.dimension[index], known.ends[index]
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    opens = first | np.append(True, ends[:-1])[: len(doc)]
    kept = kind != NOTHING
    doc, value, kind, dimension, opens = doc[kept], value[kept], kind[kept], dimension[kept], opens[kept]
    if not len(doc):
        return doc, value, np.zeros(0, bool), value
    same = np.append(False, doc[1:] == doc[:-1])
    number = kind == NUMBER
    quantity = number | (kind == UNIT) & same & np.append(False, number[:-1])
    name = (kind == NAME) & ~opens
    type_ = np.where(quantity, 1, np.where(name, 2, 0))
    head = ~(same & (type_ > 0) & (type_ == np.append(-1, type_[:-1])))
    at = np.flatnonzero(head)
    # a slot's value takes its words in order
    mixed = value * (np.uint64(2) * (np.arange(len(value)) - np.repeat(at, np.diff(np.append(at, len(value))))).astype(np.uint64) + np.uint64(1))
    slot = type_[at] > 0
    whole = np.add.reduceat(mixed, at)
    # the dimension of a quantity is its last one: places of words with one count up, so the greatest is the last
    last = np.maximum.reduceat(np.where(dimension > 0, np.arange(len(value)), -1), at)
    measured = np.where(last >= 0, dimension[last], 0).astype(np.uint64)
    return doc[at], np.where(type_[at] == 1, mix(QUANTITY + measured), np.where(type_[at] == 2, NAMED, value[at])), slot, whole


def windows(doc: np.ndarray, token: np.ndarray, slot: np.ndarray, n_texts: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (in all tokens), width and hash of the windows that count. short: a text of fewer tokens is a window."""
    n = len(token)
    start = np.arange(max(0, n - WINDOW + 1))
    words = np.append(0, np.cumsum(~slot))
    ok = (doc[start] == doc[start + WINDOW - 1]) & (words[start + WINDOW] - words[start] >= LEAST_WORDS)
    start, h = start[ok], mix(rolling(token, WINDOW)[ok])
    width = np.full(len(start), WINDOW)
    if short:
        sizes = np.bincount(doc, minlength=n_texts)
        for i in np.flatnonzero((sizes < WINDOW) & (sizes >= LEAST_WORDS)):
            a = np.searchsorted(doc, i)
            if words[a + sizes[i]] - words[a] >= LEAST_WORDS:
                start, width = np.append(start, a), np.append(width, sizes[i])
                h = np.append(h, mix(rolling(token[a : a + sizes[i]], int(sizes[i]))))
    return start, width, h


WINDOWS = "id long, at int, width int, hash long, slots array<long>"


def _rows(ids, base, start, width, h, doc, slot, value):
    """Window rows as an Arrow batch; at counts from the text's first token, slots are the values in the window."""
    import pyarrow as pa

    n = np.append(0, np.cumsum(slot))
    values, low, high = value[slot].view(np.int64), n[start], n[start + width]
    lists = [values[a:b] for a, b in zip(low, high)]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(doc[start])).cast(pa.int64()), pa.array((start - base[doc[start]]).astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
        names=["id", "at", "width", "hash", "slots"],
    )


def item_windows(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> all windows of each item."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Tokens()
        for batch in text_batches(batches):
            doc, token, slot, value = templates(batch.column("text").cast(pa.binary()).to_pylist(), known)
            start, width, h = windows(doc, token, slot, batch.num_rows, True)
            yield _rows(batch.column("item_id"), np.searchsorted(doc, np.arange(batch.num_rows)), start, width, h, doc, slot, value)

    return items.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(made, WINDOWS)


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bits, eight a byte, of the column hash: 16 for each row, at most MOST_BITS."""
    n = hashes.count()
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << max(1, 16 * n).bit_length()))
    # set where the rows are, merged as bitmaps: what reaches the driver is bounded by the bits, not by the benchmark
    places = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct().selectExpr("shiftright(bit, 3) AS byte", "shiftleft(1, CAST(bit & 7 AS INT)) AS bits")
    found = places.groupBy("byte").agg(F.sum("bits").cast("short").alias("bits")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    out[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that the bitmap has."""
    bit = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)


def document_windows(docs: DataFrame, bitmap: np.ndarray, widths: list[int]) -> DataFrame:
    """docs (doc_id, text) -> the windows whose hash the bitmap has; widths: those of short items."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Tokens()
        for batch in text_batches(batches):
            doc, token, slot, value = templates(batch.column("text").cast(pa.binary()).to_pylist(), known)
            base = np.searchsorted(doc, np.arange(batch.num_rows))
            for w in [WINDOW, *widths]:
                if len(token) < w:
                    continue
                h = mix(rolling(token, w))
                start = has(bitmap, h)
                start = start[doc[start] == doc[start + w - 1]]
                if len(start):
                    yield _rows(batch.column("doc_id"), base, start, np.full(len(start), w), h[start], doc, slot, value)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(made, WINDOWS)


def consistent(pairs: set) -> bool:
    """Whether each item value in pairs (item value, document value) has one document value, or most slots are unchanged."""
    return len({i for i, _ in pairs}) == len(pairs) or 2 * sum(i == d for i, d in pairs) > len(pairs)


def judge(hits: list[tuple], n_windows: int, n_tokens: int) -> tuple[int, int, int] | None:
    """hits (at, item_at, width, slots), slots pairs of values -> matched windows, slots and changed slots of the best alignment that counts."""
    hits = sorted(hits, key=lambda h: h[:3])
    at, item_at = (np.asarray([h[c] for h in hits], np.int64) for c in (0, 1))
    lines, length, before = at - item_at, np.ones(len(hits), np.int64), np.full(len(hits), -1)
    reach = item_at.max() - item_at.min() + SHIFT
    for k in range(len(hits)):
        low, high = np.searchsorted(at, [at[k] - reach, at[k]])
        # of equally long alignments the one with the least shift
        ok = np.flatnonzero((item_at[low:high] < item_at[k]) & (abs(lines[low:high] - lines[k]) <= SHIFT))
        if len(ok):
            best = low + ok[np.lexsort((-abs(lines[low + ok] - lines[k]), length[low + ok]))[-1]]
            length[k], before[k] = length[best] + 1, best
    good = []
    for line in np.unique(lines).tolist():
        same = np.flatnonzero(lines == line)
        k, chain = same[np.argmax(length[same])], []
        while k >= 0:
            chain.append(k)
            k = before[k]
        for ks in (same, np.asarray(chain[::-1])):
            pairs = {z for k in ks for z in hits[k][3]}
            tokens, run, most, last = set(), 0, 0, None
            for k in ks:
                _, a, w, slots = hits[k]
                tokens.update(range(a, a + w))
                kept = all(i == d for i, d in slots)
                follows = last is not None and lines[k] == lines[last] and a - hits[last][1] <= hits[last][2]
                run = 0 if not kept else run + a - hits[last][1] if follows and run else w
                most, last = max(most, run), k
            matched = len({hits[k][1] for k in ks})
            long = most >= LEAST_RUN
            if matched >= LEAST_COVER * n_windows or len(tokens) >= LEAST_COVER * (n_tokens - WINDOW + 1) + WINDOW - 1 or long:
                if consistent(pairs) or long:
                    good.append((matched, -line, len(pairs), sum(i != d for i, d in pairs)))
    if good:
        matched, _, n_slots, n_changed = max(good, key=lambda g: g[:2])
        return matched, n_slots, n_changed
    return None


FOUND = "doc_id long, item_id long, n_windows long, n_matched long, n_slots long, n_changed long"


def judged(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            hits = [(h["at"], h["item_at"], h["width"], [(z["i"], z["d"]) for z in h["zipped"]]) for h in r["hits"]]
            if best := judge(hits, r["n_windows"], r["n_tokens"]):
                out.append((r["doc_id"], r["item_id"], r["n_windows"], *best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed"])


def characters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts in lower case without white space, end to end: text number, code, whether an ASCII letter or digit goes on in the next."""
    lower = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    blank = np.isin(code, [c for c in range(0x3001) if chr(c).isspace()])
    plain = (code >= 48) & (code <= 57) | (code >= 97) & (code <= 122)
    on = np.append(plain[:-1] & plain[1:] & (doc[:-1] == doc[1:]), False)[: len(code)]
    return doc[~blank], code[~blank], on[~blank]


ENDS = "id long, at long, width int, hash long, free_before boolean, free_after boolean"


def plain_characters(text: str | None) -> str:
    """The characters of an item in lower case without white space, without signs at the ends."""
    text = "".join((text or "").lower().split())
    some = [k for k, c in enumerate(text) if c.isalnum()]
    return text[some[0] : some[-1] + 1] if some else ""


def ends(items: DataFrame) -> DataFrame:
    """items -> item_id, n, width and the hashes head and tail of the characters at both ends, for items long enough."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                plain = plain_characters(text).encode()
                if len(plain) >= LEAST_BYTES:
                    _, code, _ = characters([plain])
                    w = 1 << (len(code).bit_length() - 1)
                    h = mix(rolling(mix(code.astype(np.uint64)), w)).view(np.int64)
                    out.append((i, len(code), w, h[0], h[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["item_id", "n", "width", "head", "tail"])

    return items.select("item_id", "text").mapInArrow(made, "item_id long, n long, width int, head long, tail long")


def unsearchable(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> item_id, text of those that are never searched for: no window, and too few characters."""

    def short(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([len(plain_characters(t).encode()) < LEAST_BYTES for t in batch.column("text").to_pylist()], pa.bool_()))

    rest = items.where("item_id IS NOT NULL").select("item_id", "text")
    with_windows = item_windows(rest).select(F.col("id").alias("item_id")).distinct()
    return rest.withColumn("item_id", F.col("item_id").cast("long")).join(with_windows, "item_id", "left_anti").mapInArrow(short, "item_id long, text string")


def salted(met: DataFrame, item: DataFrame, keys: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on keys and salt: keys with many rows in met are split by the columns `by`, and the item's rows go to each salt."""
    hot = stored(met.groupBy(*keys).agg(F.ceil(F.count("*") / HOT_ROWS).alias("salts")).where("salts > 1"))
    many = met.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1)))).drop("salts")
    return many, item.join(hot, keys, "left").withColumn("salt", F.explode(F.expr("sequence(0L, coalesce(salts, 1) - 1)"))).drop("salts")


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The items (item_id, text) that stand whole in documents, with the columns of contaminated."""
    item = stored(ends(items).distinct())
    widths = [r[0] for r in item.select("width").distinct().collect()]
    both = item.select("width", F.col("head").alias("hash")).unionByName(item.select("width", F.col("tail").alias("hash"))).distinct()
    bitmap = bitmap_of(both)

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches):
            doc, code, on = characters(batch.column("text").cast(pa.binary()).to_pylist())
            base, h = np.searchsorted(doc, np.arange(batch.num_rows)), mix(code.astype(np.uint64))
            for w in widths:
                if len(code) < w:
                    continue
                hs = mix(rolling(h, w))
                start = has(bitmap, hs)
                start = start[doc[start] == doc[start + w - 1]]
                if len(start):
                    before = (start == 0) | ~on[start - 1]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[start])).cast(pa.int64()), pa.array(start - base[doc[start]]), pa.array(np.full(len(start), w, np.int32)), pa.array(hs[start].view(np.int64)), pa.array(before), pa.array(~on[start + w - 1])], names=["id", "at", "width", "hash", "free_before", "free_after"])

    if not widths:
        return docs.sparkSession.createDataFrame([], FOUND)
    met = stored(docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(made, ENDS).distinct())
    starts, heads = salted(met.where("free_before"), item.withColumnRenamed("head", "hash"), ["width", "hash"], ["id", "at"])
    # ends meet by document and place, so a common one needs no salt
    head = starts.join(heads, ["width", "hash", "salt"]).select(F.col("id").alias("doc_id"), "item_id", "width", F.col("tail").alias("hash"), (F.col("at") + F.col("n") - F.col("width")).alias("at"))
    tail = met.where("free_after").select(F.col("id").alias("doc_id"), "width", "hash", "at")
    whole = head.join(tail, ["doc_id", "width", "hash", "at"]).select("doc_id", "item_id").distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return whole.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), none.alias("n_slots"), none.alias("n_changed"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, n_windows, n_matched, n_slots, n_changed: what leaked."""
    bench = stored(item_windows(items).distinct())
    sizes = bench.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("at").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + width - 1)"))))).alias("n_tokens"))
    bitmap = bitmap_of(bench.select("hash").distinct())
    # at most WINDOW widths
    widths = sorted(r[0] for r in bench.where(F.col("width") < WINDOW).select("width").distinct().collect())
    met = stored(document_windows(docs, bitmap, widths))
    item = bench.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "width", "hash", F.col("slots").alias("item_slots"))
    met_, item_ = salted(met, item, ["hash"], ["id", "at"])
    pairs = met_.join(item_, ["hash", "width", "salt"]).select(F.col("id").alias("doc_id"), "item_id", "at", "item_at", "width", F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("zipped"))
    hits = pairs.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("at", "item_at", "width", "zipped")).alias("hits"))
    # fewer matches can't be enough: each holds WINDOW tokens at most
    able = hits.join(sizes, "item_id").where((WINDOW * F.size("hits") >= F.least(F.lit(LEAST_RUN), LEAST_COVER * F.col("n_tokens"))))
    rest = items.where("item_id IS NOT NULL").join(sizes.select("item_id"), "item_id", "left_anti")
    return able.mapInArrow(judged, FOUND).unionByName(verbatim(docs, rest))
