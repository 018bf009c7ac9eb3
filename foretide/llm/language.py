"""Languages of words and documents by a linear-chain conditional random field.

A word is a run of letters in lower case. Its features are hashed byte n-grams of 1 to `LONGEST` bytes of the word between
two spaces, so that those which touch a space are affixes, and the word itself where it is in the lexicon of training
words. A state is a language; moves between states are learned. The field is fitted by Adam on the conditional
log-likelihood of word sequences made from training documents of one language each, cut into stretches of about
`STRETCH` words and dealt anew, so that languages change inside a sequence as in code-switched text.

Forward-backward gives each word's chance of each language, exactly over the whole text: a text is cut into blocks of
`CORE` words, the product of a block's matrices is worked out for all blocks at once, messages run from block to block,
and then through all blocks at once. A document's language is the one with the greatest sum of its words' chances,
weighted by their lengths; its score is that language's share.

Training reads documents outside the fold with a language and text of at most `MOST_BYTES` bytes, about `MOST_DOCS` a
language chosen by a hash of their ids; at most `MOST_LANGS` languages are learned, those of most documents.

Rows: a null text, or one without a letter, is `und` with score 0, as is every text where nothing could be learned.
Repeated rows and ids are judged each on its own; in training an id counts once, with its least language and text. Ties
go to the first language by name. An empty table gives no rows; extra columns are ignored. Language, source and id are
never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import mix, text_batches

LONGEST, BUCKETS = 4, 1 << 16
#: Bounds of the training sample: documents of each language (about), bytes of each, languages.
MOST_DOCS, MOST_BYTES, MOST_LANGS = 80, 30_000, 100
#: Words of a training sequence, and of one language in a row, on the average.
SEQUENCE, STRETCH = 64, 12
#: Training words that are in the lexicon are in so many training documents at least.
LEAST_SEEN = 3
#: Words of a block of forward-backward.
CORE = 64
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each byte of the words between spaces (BUCKETS where one would leave its word), n by n, and each byte's word."""
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    out, h = np.full((LONGEST, len(flat)), BUCKETS, np.int64), np.zeros(len(flat), np.uint64)
    for n in range(1, LONGEST + 1):
        k = len(flat) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        inside = owner[:k] == owner[n - 1 :]
        out[n - 1, :k][inside] = (mix(h[inside] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return out, owner


@dataclass
class Field:
    languages: list[str]
    lexicon: dict[bytes, int]
    tables: np.ndarray  # n-gram lengths x (buckets + 1) x languages
    whole: np.ndarray  # lexicon + 1 x languages
    move: np.ndarray  # languages x languages
    first: np.ndarray  # languages

    def emit(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word (not empty) for each language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        index, owner = grams(words)
        starts = np.flatnonzero(np.append(True, np.diff(owner) > 0))
        parts = sum(t[i] for t, i in zip(self.tables, index))
        return np.add.reduceat(parts, starts, 0) + self.whole[[self.lexicon.get(w, len(self.lexicon)) for w in words]]


# ---- forward-backward ----


def chances(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """emit: words of all texts end to end x states -> each word's chance of each state; sizes: words of each text."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    sizes = sizes[sizes > 0]
    # blocks of each text, padded; a padded place changes nothing
    per = -(-sizes // CORE)
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + number * CORE
    left = sizes[text] - number * CORE
    places = np.arange(CORE)
    live = places[:, None] < left[None]
    goes = places[:, None] + 1 < left[None]  # a word with another after it in its text
    at = np.minimum(begin[None] + places[:, None], n - 1)
    e = np.exp(np.maximum(emit - emit.max(1, keepdims=True), -69.0))
    e = np.where(live[..., None], e[at], 1.0)
    step = np.exp(move - move.max())
    # the product of each block's matrices
    whole = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(CORE):
        whole *= e[t][:, None, :]
        whole = np.where(goes[t][:, None, None], (whole.reshape(-1, k) @ step).reshape(-1, k, k), whole)
        if t % 4 == 3:
            whole /= whole.max((1, 2), keepdims=True)
    # messages into blocks from before and from behind, block by block, all texts at once
    fwd, bwd = np.zeros((len(text), k)), np.ones((len(text), k))
    place = np.cumsum(per) - per
    fwd[place] = np.exp(first - first.max())
    by_length = np.argsort(-per, kind="stable")
    counts = np.searchsorted(-per[by_length], -np.arange(1, per.max()), "left")  # texts of more than j blocks
    for j in range(1, per.max()):
        own = place[by_length[: counts[j - 1]]] + j
        m = np.einsum("rk,rkl->rl", fwd[own - 1], whole[own - 1])
        fwd[own] = m / m.max(1, keepdims=True)
    for j in range(per.max() - 1, 0, -1):
        own = place[by_length[: counts[j - 1]]] + j
        m = np.einsum("rkl,rl->rk", whole[own], bwd[own])
        bwd[own - 1] = m / m.max(1, keepdims=True)
    # through the blocks
    ahead = np.zeros((CORE, len(text), k))
    p = fwd
    for t in range(CORE):
        ahead[t] = p * e[t]
        p = np.where(goes[t][:, None], ahead[t] @ step, ahead[t])
        p = p / p.max(1, keepdims=True)
    out, q = np.zeros((n, k)), bwd
    for t in range(CORE - 1, -1, -1):
        behind = np.where(goes[t][:, None], q @ step.T, q)
        both = ahead[t] * behind
        on = live[t]
        out[at[t][on]] = both[on] / both[on].sum(1, keepdims=True)
        q = e[t] * behind
        q = q / q.max(1, keepdims=True)
    return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(emit: np.ndarray, move: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Minus the conditional log-likelihood of states y (sequences x words) under emit (sequences x words x states), and its gradients by emit, move and first."""
    n, k = y.shape[1], emit.shape[2]
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0] + first
    for t in range(1, n):
        fwd[:, t] = _lse(fwd[:, t - 1, :, None] + move, 1) + emit[:, t]
    for t in range(n - 2, -1, -1):
        bwd[:, t] = _lse(move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
    z = _lse(fwd[:, -1], 1)
    rows = np.arange(len(y))[:, None]
    own = emit[rows, np.arange(n), y].sum(1) + first[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
    near = np.exp(fwd + bwd - z[:, None, None])
    moved = np.zeros_like(move)
    for t in range(1, n):
        moved += np.exp(fwd[:, t - 1, :, None] + move + (emit[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]).sum(0)
    moved -= np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    near[rows, np.arange(n), y] -= 1
    return float((z - own).sum()), near, moved, near[:, 0].sum(0)


# ---- training ----


def sequences(docs: list[list[int]], states: list[int], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words (numbers) of documents of one state each, cut into stretches and dealt anew: words and states, sequences x SEQUENCE."""
    r = np.random.default_rng(seed)
    stretches = []
    for words, state in zip(docs, states):
        at = 0
        while at < len(words):
            end = at + int(r.geometric(1 / STRETCH))
            stretches.append((words[at:end], state))
            at = end
    order = r.permutation(len(stretches))
    flat = np.concatenate([np.asarray(stretches[i][0], np.int64) for i in order])
    y = np.concatenate([np.full(len(stretches[i][0]), stretches[i][1]) for i in order])
    # the last sequence is filled up from the beginning
    places = np.arange(-(-len(flat) // SEQUENCE) * SEQUENCE) % len(flat)
    return flat[places].reshape(-1, SEQUENCE), y[places].reshape(-1, SEQUENCE)


def words_of(text: str) -> list[bytes]:
    return " ".join(_LETTERS.findall(text.lower())).encode().split()


def fit(texts: list[str], languages: list[str], steps: int = 30, decay: float = 0.02) -> Field:
    """The field of texts of one language each."""
    names = sorted(set(languages))
    k = len(names)
    split = [words_of(t) for t in texts]
    seen = Counter(w for ws in split for w in set(ws))
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_SEEN))}
    field = Field(names, lexicon, np.zeros((LONGEST, BUCKETS + 1, k)), np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k))
    vocabulary = sorted(seen)
    if not vocabulary:
        return Field([], {}, field.tables, field.whole, field.move, field.first)
    number = {w: i for i, w in enumerate(vocabulary)}
    x, y = sequences([[number[w] for w in ws] for ws in split], [names.index(s) for s in languages])
    index, owner = grams(vocabulary)
    known = np.asarray([lexicon.get(w, len(lexicon)) for w in vocabulary])
    params = [field.tables, field.whole, field.move, field.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        _, near, g_move, g_first = likelihood(field.emit(vocabulary)[x], field.move, field.first, y)
        by_word = np.stack([np.bincount(x.ravel(), near[..., j].ravel(), len(vocabulary)) for j in range(k)], 1)
        g_tables, g_whole = np.zeros_like(field.tables), np.zeros_like(field.whole)
        for j in range(k):
            spread = by_word[owner, j]
            for i in range(LONGEST):
                g_tables[i, :, j] = np.bincount(index[i], spread, BUCKETS + 1)
            g_whole[:, j] = np.bincount(known, by_word[:, j], len(lexicon) + 1)
        g_tables[:, -1], g_whole[-1] = 0, 0  # no n-gram, no word of the lexicon
        for p, g, mm, vv in zip(params, [g_tables, g_whole, g_move, g_first], m, v):
            g = g + decay * p
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p -= 0.1 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return field


def train(docs: DataFrame) -> Field:
    """The field of a bounded sample of the documents (doc_id, lang, text) outside the fold."""
    able = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= MOST_BYTES))
    ids = able.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)  # a row a language
    # by hash: MOST_DOCS a language on the average, and all where there are fewer
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) * F.col("n") < F.lit(MOST_DOCS * (1 << 40))
    chosen = ids.join(F.broadcast(counts), "lang").where(draw).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * MOST_DOCS * MOST_LANGS)
    sample = able.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "lang")), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id")
    rows = sample.collect()  # 3 * MOST_DOCS * MOST_LANGS texts of MOST_BYTES at the very most
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


# ---- prediction ----


class Emissions(dict):
    """Word (bytes) -> row of its scores."""

    def __init__(self, field: Field, most: int = 300_000):
        super().__init__()
        self.field, self.most = field, most
        self.rows = np.zeros((0, len(field.languages)), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words) - self.keys())
        if len(self) + len(new) > self.most:
            self.clear()
            self.rows, new = self.rows[:0], list(set(words))
        if new:
            self.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.field.emit(new).astype(np.float32)])
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].astype(float)


def judged(texts: list[str | None], known: Emissions) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text, and the chances of all words end to end."""
    split = [words_of(t) if t else [] for t in texts]
    field = known.field
    return split, chances(known.of([w for ws in split for w in ws]), np.asarray([len(ws) for ws in split], np.int64), field.move, field.first)


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, n_words, n_switches (how often the likeliest language of neighbouring words changes)."""
    schema = "doc_id long, lang_pred string, score double, n_words long, n_switches long"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Emissions(field)
        for batch in text_batches(batches):
            split, near = judged(batch.column("text").to_pylist(), known)
            sizes = np.asarray([len(ws) for ws in split], np.int64)
            text = np.repeat(np.arange(len(split)), sizes)
            weight = np.asarray([len(w) for ws in split for w in ws], float)
            sums = np.stack([np.bincount(text, near[:, j] * weight, len(split)) for j in range(near.shape[1])], 1)
            best, total = sums.argmax(1), np.bincount(text, weight, len(split))
            score = np.where(total > 0, np.minimum(1.0, sums.max(1) / np.maximum(total, 1)), 0.0)
            likely = near.argmax(1)
            changes = np.bincount(text[1:][(likely[1:] != likely[:-1]) & (text[1:] == text[:-1])], minlength=len(split))
            names = [field.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names), pa.array(score), pa.array(sizes), pa.array(changes.astype(np.int64))], names=[f.split()[0] for f in schema.split(", ")])

    if not field.languages:
        zero = F.lit(0).cast("long")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), zero.alias("n_words"), zero.alias("n_switches"))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def stretches(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, end (code points), lang, score: runs of words with the same likeliest language, and its mean chance."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Emissions(field)
        for batch in text_batches(batches):
            texts = batch.column("text").to_pylist()
            split, near = judged(texts, known)
            out, at = [], 0
            for i, (text, words) in enumerate(zip(texts, split)):
                own, place = near[at : at + len(words)], [m.span() for m in _LETTERS.finditer(text or "")]
                at += len(words)
                likely = own.argmax(1)
                cut = np.flatnonzero(np.append(True, likely[1:] != likely[:-1])).tolist() if len(words) else []
                for a, b in zip(cut, [*cut[1:], len(words)]):
                    out.append((i, place[a][0], place[b - 1][1], field.languages[likely[a]], float(own[a:b, likely[a]].mean())))
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[c] for o in out], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.float64())))], names=["doc_id", "start", "end", "lang", "score"])

    schema = "doc_id long, start long, end long, lang string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema) if field.languages else docs.sparkSession.createDataFrame([], schema)


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches of every document."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
