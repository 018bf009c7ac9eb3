"""Repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.llm import repeats
from foretide.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, ws in split:
        if d is not None:
            for i in range(len(ws) - 49):
                k = tuple(ws[i : i + 50])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, ws in split:
        gone = np.zeros(len(ws), bool)
        if d is not None:
            for i in range(len(ws) - 49):
                if least[tuple(ws[i : i + 50])] < d:
                    gone[i : i + 50] = True
        left = [w for w, g in zip(ws, gone) if not g]
        out.append((d, len(ws), int(gone.sum()), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in repeats.repeated_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def made(seed, n=120):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 50)) for _ in range(k))
    passages = [text(k) for k in (50, 51, 60, 75, 130, 400)]
    line = text(16)
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.randint(0, 60))]
        if r.random() < 0.6:
            parts.insert(r.randint(0, len(parts)), line)
        rows.append((i, " ".join(parts)))
    for i in range(n, n + 20):
        ws = r.choice(rows)[1].split(" ")
        if i % 3 and len(ws) > 3:
            ws[r.randint(0, len(ws) - 1)] = "changed"
        rows.append((i, "  ".join(ws) if i % 2 else "\n".join(ws)))
    rows.append((n + 20, "x " * 300))
    rows.append((n + 21, "x " * 120))
    rows += [(n + 22, None), (n + 23, ""), (None, rows[0][1]), (None, None), rows[5], (5, rows[7][1]), (5, passages[-1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1024, 2])
def test_made(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_WORDS", 5000)
    rows = made(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit("x")).withColumn("a", F.lit(1))
    assert run(df) == brute(rows)


def test_common_passage(spark, monkeypatch):
    """One line and one passage in all documents, each among words of its own: keys are halved down to whole windows."""
    monkeypatch.setattr(repeats, "HOT", 4)
    r = random.Random(8)
    own = lambda k: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(k))
    line, passage, sides = own(20), own(57), [own(3) for _ in range(3)]
    rows = [(i, " ".join([own(60), line, own(70), r.choice(sides), passage, r.choice(sides), own(r.randint(0, 60))])) for i in range(150)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_index_matches_brute_force():
    r = np.random.default_rng(1)
    passages = [r.integers(0, 4, r.integers(8, 60)).astype(np.uint64) for _ in range(30)]
    queries = [r.integers(0, 5, r.integers(1, 60)).astype(np.uint64) for _ in range(40)] + passages[:5]
    ids = r.permutation(30)
    found = repeats.Index(passages, ids, window=6).search(queries)
    for q, row in zip(queries, found):
        row = row[len(row) - len(q) :]
        for i in range(len(q)):
            w = q[i : i + 6]
            have = [d for p, d in zip(passages, ids) if len(w) == 6 and any((p[j : j + 6] == w).all() for j in range(len(p) - 5))]
            assert row[i] == (min(have) if have else repeats.NONE)
