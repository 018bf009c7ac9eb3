"""The manifest against trees built level by level, on made rows and on the supplied documents."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foretide.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    """(before, after) at each level."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text)"""
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((first(r[0]), leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda g: (g[0][0], g[0][1] or 0, g[1]))
        trees[s] = up([g[1] for g in groups[s]])
    top = up([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, r) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            digest = leaf(*r[:4], r[4].replace("\n", "")) if spoilt else own
            for before, after in steps:
                digest = h("".join([*before, digest, *after]))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h("".join(d for b, a in steps for d in b + a)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def made(n, sources, seed):
    r = random.Random(seed)
    texts = ["", None, "a\nb", "ü\n\n", "plain", "x" * 5000 + "\n", " \n"]
    return [(r.choice([None, i, i, i, 7, -i]), r.choice(sources), r.choice(["en", None]), r.choice([None, 3]), r.choice(texts)) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, sources, chunk", [(1, ["a"], 5), (2, ["a", None], 5), (9, ["a"], 2), (40, ["a", "b", None, "é", "z", ""], 4), (150, ["hot"] * 8 + [f"s{i}" for i in range(30)], 7), (81, ["one"], 3)])
def test_trees(spark, monkeypatch, n, sources, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "MOST_PARTS", 5)
    monkeypatch.setattr(M, "FAN", 3)
    rows = made(n, sources, n)
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, leaf int").repartition(4)
    got = M.document_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_repeated_rows_and_empty(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 4)
    rows = [(5, "s", "en", 1, "a\nb")] * 30 + [(6, "t", "en", 1, "a")]
    got = M.document_manifest(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert M.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_merging_is_associative(seed):
    """Fragments cut anywhere and merged in any order leave the same nodes, the root in the end."""
    r = random.Random(seed)
    sizes = {t: r.randint(1, 40) for t in range(r.randint(1, 9))}
    sizes[M.TOP] = len(sizes)
    nodes = {(t, 0, i): h(f"{t}:{i}") for t, n in sizes.items() if t != M.TOP for i in range(n)}
    parts = [{} for _ in range(5)]
    for k, d in nodes.items():
        r.choice(parts)[k] = d
    merge = lambda *fs: M.resolve({k: d for f in fs for k, d in f.items()}, sizes)[0]
    a, b, c, d, e = parts
    assert merge(merge(a, b), c) == merge(a, merge(b, c)) == merge(c, a, b)
    root = merge(merge(merge(e, c), a), merge(d, b))
    assert root == merge(*parts) and len(root) == 1 and next(iter(root))[0] == M.TOP


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = M.document_manifest(docs)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == brute(rows)
    assert got.where(~F.col("verified")).count() > 0
