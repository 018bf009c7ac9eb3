"""Toxicity: accuracy on held-out labels, and sentences that are located."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from foretide.llm import toxicity
from foretide.llm.common import table


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    pos, neg = (held[held["toxic"] == t]["score"].to_numpy() for t in (1, 0))
    assert np.mean(pos[:, None] > neg) + 0.5 * np.mean(pos[:, None] == neg) > 0.93
    assert np.mean(neg >= 0.7) < 0.01 and np.mean(pos >= 0.7) > 0.7
    assert got["score"].between(0, 1).all()


def test_only_labels_in_the_fold_are_read(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_noisy_or_locates_sentences():
    calm, bad = ["the cat sat on the mat. rain fell.", "a warm day. bread and tea."] * 40, ["the cat sat. you are a zork fool. rain fell."] * 40
    model = toxicity.fit(calm + bad, [0] * 80 + [1] * 40)
    text = "rain fell. what a zork! bread and tea."
    (span,) = [s for s in model.sentence_scores(text) if s[2] >= 0.5]
    assert text[span[0] : span[1]] == "what a zork!"
    whole = model.score(model.sentence_scores(text))
    assert abs(whole - (1 - np.exp(-model.leak) * np.prod([1 - p for *_, p in model.sentence_scores(text)]))) < 1e-12


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "zork"), (3, "a"), (3, "a")], "doc_id long, text string").withColumn("score", F.lit(5))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 5 and all(r["predicted"] == 0 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_fit_and_score_by_brute_force():
    """The fitted weights against the objective written out: no move within the bounds lowers it; scores against the product over sentences."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts, toxic = [], []
    for d in range(160):
        ws = list(r.choice(words, 20))
        bad = d % 4 == 0
        if bad:
            ws[3:3] = list(r.choice(["zork", "grumf"], 2)) if r.uniform() < 0.9 else []
        elif r.uniform() < 0.05:
            ws[0] = "zork"
        texts.append(". ".join(" ".join(ws[k : k + 5]) for k in range(0, len(ws), 5)) + ".")
        toxic.append(int(bad))
    model = toxicity.fit(texts, toxic, steps=3000)
    assert {b"zork", b"grumf"} <= model.weights.keys()
    names = sorted(model.weights)
    counts = np.array([[sum(w in toxicity.features_of(s.encode()) for s in t.split(".") if s.strip()) for w in names] for t in texts], float)
    y, share = np.array(toxic, bool), np.mean(toxic)
    weight = np.where(y, 1.0, y.sum() / (~y).sum() * (1 - share) / share)

    def objective(theta, leak):
        s = leak + counts @ theta
        return (weight * np.where(y, -np.log1p(-np.exp(-s)), s)).sum() + 2.0 * theta.sum()

    theta, leak = np.array([model.weights[n] for n in names]), model.leak
    best = objective(theta, leak)
    for i in range(len(names)):
        for step in (-0.05, 0.05):
            moved = theta.copy()
            moved[i] = max(0, moved[i] + step)
            assert objective(moved, leak) > best - 0.05
    assert objective(theta, leak + 0.05) > best - 0.05 and objective(theta, max(1e-6, leak - 0.05)) > best - 0.05
    for t, c in zip(texts[:20], counts):
        chance = 1 - np.exp(-leak) * np.prod([np.exp(-sum(model.weights.get(w, 0) for w in toxicity.features_of(s.encode()))) for s in t.split(".")])
        assert abs(model.score(model.sentence_scores(t)) - chance) < 1e-9
        assert abs(chance - (1 - np.exp(-leak - c @ theta))) < 1e-9
