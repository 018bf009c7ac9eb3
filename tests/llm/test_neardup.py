"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.llm import neardup
from foretide.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    ids, parent = sorted(sets), {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted((d, len(shingles(t)), top(d), d == top(d)) for d, t in rows)


def run(df):
    return sorted(tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def made(seed=5):
    r = random.Random(seed)
    text = lambda k: [r.choice("abcdefgh") + str(r.randint(0, 400)) for _ in range(k)]
    rows, n = [], 0
    for k in (1, 3, 5, 6, 12, 30, 80, 200, 900):
        base = text(k)
        for _ in range(14):
            ws = list(base)
            for _ in range(r.randint(0, max(1, k // 25))):
                ws[r.randrange(k)] = "new" + str(r.randint(0, 9))
            rows.append((n, r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in ws)))
            n += 1
    # a chain: each text near the next, the ends far apart
    ws = text(300)
    for i in range(20):
        ws[i * 12 : i * 12 + 3] = text(3)
        rows.append((n, " ".join(ws)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), rows[0], rows[5], (3, rows[-1][1]), (3, rows[-4][1])]
    r.shuffle(rows)
    return rows


def test_made(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(0)).withColumn("sig", F.lit("x"))
    assert run(df) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    df = table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text")
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_edge_rows(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, None), (5, "a b c"), (None, "a b c")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None, True)] * 2 + [(4, 0, 4, True), (5, 1, 5, True)], key=str)


def test_hub(spark):
    """One original with a middle id and 1000 edited copies, each alike to it and most unlike each other."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(1001):
        if i != 500:
            ws = list(base)
            for k in r.sample(range(2, 398, 5), r.randint(8, 10)):
                ws[k] = f"x{i}y{k}"
            rows.append((i, " ".join(ws)))
    sets = {d: shingles(t) for d, t in rows}
    assert all(100 * len(s & sets[500]) >= 75 * len(s | sets[500]) for s in sets.values())
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(c, k) for d, _, c, k in got if d} == {(0, False)}


@pytest.mark.parametrize("block", [4_000_000, 20_000])
def test_crowded_buckets(spark, monkeypatch, block):
    """Many words in all documents: pairs just over the threshold among hundreds of texts just under it, in the same buckets."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    core = [f"c{i}" for i in range(854)]
    rows = []
    for i in range(600):
        own = [f"d{i}x{k}" for k in range(145)]
        if i < 200:  # 2k and 2k + 1 share some words
            own[:5] = [f"pair{i // 2}x{k}" for k in range(5)]
        rows.append((i, " ".join(core + own)))
    sets = [shingles(t) for _, t in rows[:4]]
    assert 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]) and 100 * len(sets[1] & sets[2]) < 75 * len(sets[1] | sets[2])
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [c for _, _, c, _ in got] == [i - i % 2 if i < 200 else i for i in range(600)]


def test_link_against_all_pairs():
    r = np.random.default_rng(4)
    for n in (2, 7, 40):
        sets = [np.unique(r.integers(0, 30, r.integers(1, 30)).astype(np.uint64)) for _ in range(n)]
        comp = r.integers(0, n, n)
        for first in (np.ones(n, bool), r.random(n) < 0.5):
            parent = {c: {c} for c in comp.tolist()}
            for i in range(n):
                for j in range(i):
                    x, y = set(sets[i].tolist()), set(sets[j].tolist())
                    if (first.all() or first[i] != first[j]) and 100 * len(x & y) >= 75 * len(x | y) and parent[comp[i]] is not parent[comp[j]]:
                        both = parent[comp[i]] | parent[comp[j]]
                        parent |= {c: both for c in both}
            got = {c: {c} for c in comp.tolist()}
            for a, b in neardup.link(comp, sets, first):
                assert got[a] is not got[b]
                both = got[a] | got[b]
                got |= {c: both for c in both}
            assert got == parent


@pytest.mark.parametrize("n", [3, 10])
def test_one_id_with_many_texts(spark, n):
    """All texts of an id are one document: documents that share any of them are linked, whatever is the least of each."""
    r = random.Random(n)
    texts = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(40)) for _ in range(n)]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(50, t) for t in texts] + [(60, texts[-1]), (61, "none of these at all here"), (70, texts[1] + " more"), (70, "some other words stand in this text")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and {g[2] for g in got if g[0] != 61} == {1}


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """Texts that share half their words share buckets and no links; the comparison of their blocks needs no second pass over all texts."""
    r = random.Random(3)
    word = lambda: "w" + str(r.randint(0, 10**6))
    common = [word() for _ in range(120)]
    rows = [(i, " ".join([*common, *(word() for _ in range(60))])) for i in range(24)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(4)]
    calls, full_sets = [], neardup.full_sets
    monkeypatch.setattr(neardup, "full_sets", lambda *a: calls.append(1) or full_sets(*a))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(calls) == 1
