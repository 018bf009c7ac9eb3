"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A sentence's features are its words and, as insults also come as compounds, the first 5, 6 and 7 bytes of longer words.
A sentence with feature weights a (all at least 0) is toxic with probability 1 - exp(-sum of a), and a document with
probability 1 - exp(-leak) * product over sentences of (1 - that), the noisy-or of its sentences and a leak for labels
that no word explains. The weights are fitted by projected gradient descent with an L1 penalty on at most
`MOST_TRAIN` labelled documents of each class, chosen by a hash of their ids, each of at most `MOST_BYTES` bytes.

Rows: a null or empty text has the score of the leak alone. A label row without a label or without a document is
ignored; of several labels of one document the greatest holds; repeated document rows are scored each on its own.
Without any usable label, or with one class only, every weight is 0 and the leak is the share of toxic labels. An
empty table gives no rows; extra columns are ignored. Labels of held-out documents, lang, source and doc_id never
enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import text_batches

#: Bounds of the training sample: documents of each class, and bytes of each document.
MOST_TRAIN, MOST_BYTES = 2000, 60_000
#: A feature must be in so many toxic training documents.
LEAST_DOCS = 4
THRESHOLD = 0.7

#: Bytes to words: A-Z to a-z, ASCII signs and white space to a space; other bytes stay.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n。！？]+[.!?。！？]*")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


#: Lengths in bytes of the beginnings of longer words.
BEGINNINGS = (5, 6, 7)


def features_of(text: bytes, lengths: tuple[int, ...] = BEGINNINGS) -> set[bytes]:
    """The words of a text, and the beginnings of longer ones, each followed by an asterisk."""
    words = set(words_of(text))
    return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in lengths))


@dataclass
class Model:
    weights: dict[bytes, float]
    leak: float

    def __post_init__(self):
        self.lengths = tuple(sorted({len(w) - 1 for w in self.weights if w.endswith(b"*")}))

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """start, end, probability of each sentence that has any weighted word."""
        out = []
        for m in _SENTENCE.finditer(text):
            a = sum(self.weights.get(w, 0.0) for w in features_of(m.group().encode(), self.lengths))
            if a > 0:
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                out.append((start, m.end(), 1 - math.exp(-a)))
        return out

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        return 1 - math.exp(-self.leak) * math.prod(1 - p for _, _, p in sentences)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(texts: list[str], toxic: list[int], share: float | None = None, steps: int = 400, penalty: float = 2.0) -> Model:
    """Fit on documents; share: the share of toxic ones where the documents come from."""
    y = np.asarray(toxic, bool)
    share = share if share is not None else float(y.mean()) if len(y) else 0.0
    counts: list[Counter] = []
    for t in texts:
        counts.append(Counter(w for m in _SENTENCE.finditer(t) for w in features_of(m.group().encode())))
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    if not n_pos or not n_neg:
        return Model({}, -math.log(max(1e-9, 1 - min(share, 1 - 1e-9))))
    in_pos, in_neg = Counter(), Counter()
    for c, t in zip(counts, y):
        (in_pos if t else in_neg).update(c.keys())
    kept = sorted(w for w, n in in_pos.items() if n >= LEAST_DOCS and n / n_pos > 3 * in_neg.get(w, 0) / n_neg)
    at = {w: i for i, w in enumerate(kept)}
    pairs = [(d, at[w], n) for d, c in enumerate(counts) for w, n in c.items() if w in at]
    doc, word, n = (np.asarray([p[i] for p in pairs], np.int64) for i in range(3))
    # negatives count for as many documents as they stand for
    weight = np.where(y, 1.0, n_pos / n_neg * (1 - share) / max(share, 1e-9))
    theta, leak = np.full(len(kept), 0.05), max(share, 1e-3)
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        s = leak + np.bincount(doc, theta[word] * n, len(y)) if len(doc) else np.full(len(y), leak)
        slope = weight * np.where(y, -1 / np.expm1(np.clip(s, 1e-6, 50)), 1.0)
        g = np.append(np.bincount(word, slope[doc] * n, len(kept)) + penalty if len(doc) else np.zeros(0), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta, leak = np.maximum(0, theta - move[:-1]), max(1e-6, leak - 0.05 * move[-1])
    return Model({w: float(t) for w, t in zip(kept, theta) if t > 0.02}, float(leak))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id")
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(MOST_TRAIN)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * MOST_TRAIN rows of ids; of several texts of one id the least
    sample = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(order, "doc_id")
    rows = sample.collect()
    total = sum(sizes.values())
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows], sizes.get(1, 0) / total if total else 0.0)


def _scored(model: Model, batch) -> tuple[list[float], list[str]]:
    """Score, and sentences of probability 0.5 or more, of each text of a batch."""
    import pyarrow as pa

    scores, spans = [], []
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        found = []
        if text and not model.weights.keys().isdisjoint(features_of(text, model.lengths)):
            found = model.sentence_scores(text.decode())
        scores.append(model.score(found))
        spans.append(",".join(f"{a}:{b}" for a, b, p in found if p >= 0.5))
    return scores, spans


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches):
            yield batch.filter(pa.array([s < THRESHOLD for s in _scored(model, batch)[0]]))

    return docs.mapInArrow(clean, docs.schema)


SCORED = "score double, predicted int, toxic_spans string"


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> the columns keep (default doc_id), score, predicted, and the sentences of probability 0.5 or more as start:end in code points."""
    keep = keep or ["doc_id"]
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + SCORED

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches):
            scores, spans = _scored(model, batch)
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "score", "predicted", "toxic_spans"])

    return docs.select(*columns).mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans of every document."""
    return score_documents(docs, train(docs, labels)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "toxic_spans")
