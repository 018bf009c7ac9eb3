"""Languages: forward-backward and gradient by brute force, held-out accuracy, code-switched text, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.llm import language as L
from foretide.llm.common import table


def paths(emit, move, first):
    """Scores of all state paths of one text."""
    n, k = emit.shape
    return {p: first[p[0]] + sum(emit[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=n)}


@pytest.mark.parametrize("core", [1, 2, 3, 64])
def test_chances(monkeypatch, core):
    monkeypatch.setattr(L, "CORE", core)
    r = np.random.default_rng(core)
    sizes, k = np.array([5, 0, 1, 7, 2, 0, 6, 3]), 3
    emit, move, first = 3 * r.normal(size=(sizes.sum(), k)), r.normal(size=(k, k)), r.normal(size=k)
    got, at = L.chances(emit, sizes, move, first), 0
    for n in sizes:
        want = np.zeros((n, k))
        if n:
            each = paths(emit[at : at + n], move, first)
            for p, s in each.items():
                want[np.arange(n), list(p)] += np.exp(s)
            want /= want.sum(1, keepdims=True)
        np.testing.assert_allclose(got[at : at + n], want, atol=1e-9)
        at += n


def test_long_text_is_exact():
    """Blocks change nothing: a long text against messages word by word, with scores far apart."""
    r = np.random.default_rng(1)
    emit, move, first = 40 * r.normal(size=(3000, 4)), 3 * np.eye(4), np.zeros(4)
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    e = np.maximum(emit - emit.max(1, keepdims=True), -69.0)
    fwd[0] = first + e[0]
    for t in range(1, 3000):
        fwd[t] = L._lse(fwd[t - 1][:, None] + move, 0) + e[t]
    for t in range(2998, -1, -1):
        bwd[t] = L._lse(move + (e[t + 1] + bwd[t + 1])[None], 1)
    both = fwd + bwd
    np.testing.assert_allclose(L.chances(emit, np.array([3000]), move, first), np.exp(both - L._lse(both, 1)[:, None]), atol=1e-8)


def test_gradient():
    r = np.random.default_rng(2)
    emit, move, first, y = r.normal(size=(3, 5, 3)), r.normal(size=(3, 3)), r.normal(size=3), r.integers(0, 3, size=(3, 5))
    value, *grads = L.likelihood(emit, move, first, y)
    want = -sum(paths(e, move, first)[tuple(s)] - np.log(sum(map(np.exp, paths(e, move, first).values()))) for e, s in zip(emit, y))
    assert abs(value - want) < 1e-9
    for p, g in zip((emit, move, first), grads):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            up = L.likelihood(emit, move, first, y)[0]
            p[i] -= 2e-5
            down = L.likelihood(emit, move, first, y)[0]
            p[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_features():
    index, owner = L.grams([b"ab", b"b", "é".encode()])
    assert owner.tolist() == [0] * 4 + [1] * 3 + [2] * 4
    assert (index[1] == L.BUCKETS).tolist() == [False, False, False, True, False, False, True, False, False, False, True]
    assert index[0, 2] == index[0, 5] and index[1, 2] == index[1, 5] and index[1, 0] != index[1, 4]  # "b", "b " as the end of both


ENGLISH, GERMAN = "the cat sat on the mat while rain was falling over there".split(), "die katze lag auf der matte und es regnete draußen wieder".split()


def made(words, n, seed):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(words, 30)) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    return L.fit(made(ENGLISH, 40, 1) + made(GERMAN, 40, 2), ["en"] * 40 + ["de"] * 40)


def test_code_switching(spark, field):
    text = "The cat, sat: on the mat! 12 DIE KATZE lag auf der Matte (draußen). The rain was falling."
    rows = L.stretches(spark.createDataFrame([(1, text), (2, None), (3, "..")], "doc_id long, text string"), field).orderBy("start").collect()
    assert [(r["lang"], text[r["start"] : r["end"]]) for r in rows] == [("en", "The cat, sat: on the mat"), ("de", "DIE KATZE lag auf der Matte (draußen"), ("en", "The rain was falling")]
    assert all(0.5 < r["score"] <= 1 for r in rows)


def test_odd_rows(spark, field):
    long = "die katze lag draußen " * 30_000
    rows = [(1, None), (2, ""), (3, "12 3.4 !? \n"), (None, "the cat sat"), (5, long), (5, "the rain"), (5, "the rain"), (6, "x" * 100_000), (7, "日本語"), (8, "die"), (9, "a퟿b \U0010ffff")]
    df = spark.createDataFrame([(*r, "fr", 3) for r in rows], "doc_id long, text string, lang string, score int")
    got = L.predict(df, field).collect()
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g)
    assert len(got) == len(rows) and [(by[i][0]["lang_pred"], by[i][0]["score"]) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by[None][0]["lang_pred"] == "en" and by[8][0]["lang_pred"] == "de"
    assert sorted((g["lang_pred"], g["n_words"]) for g in by[5]) == [("de", 120_000), ("en", 2), ("en", 2)]
    assert all(g["lang_pred"] in ("en", "de") and 0 <= g["score"] <= 1 for i in (6, 7, 9) for g in by[i])
    for empty in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string"))):
        assert {r["lang_pred"] for r in L.document_languages(empty).collect()} <= {"und"}
    assert L.document_languages(df.limit(0)).count() == 0
    one = L.document_languages(df).collect()  # one language only
    assert any(zlib.crc32(str(i).encode()) % 3 != 1 for i in (5, 7, 8)) and {r["lang_pred"] for r in one} == {"fr", "und"}


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = L.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.995 and got["score"].between(0, 1).all()


def test_only_the_fold_is_learned_from(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (sorted(map(tuple, L.document_languages(d).collect())) for d in (docs, other))
    assert a == b
