"""Queries that SQL can express, against DuckDB; the guard of the entry module; edge rows of the native operators."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from foretide.llm import chat, entry, licenses, urls

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(names).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op9_preference", "op10_urls"])
def test_native(spark, name):
    plan = entry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_operator_has_one_query():
    assert [sum(k.startswith(f"op{n}_") for k in entry.QUERIES) for n in range(1, 14)] == [1] * 13


def test_urls(spark):
    rules = spark.createDataFrame([("allow", "org", "/"), ("block", "a.org", "/x"), ("block", "b.a.org", "/x"), ("allow", "B.a.org", "/x/y"), ("block", "a.org", "/x")], "verdict string, host string, path string")
    cases = {
        "http://A.org/xx": ("a.org", "/xx", "a.org/x", "block"), "http://c.b.a.org/x/y/z?q": ("c.b.a.org", "/x/y/z", "b.a.org/x/y", "allow"), "http://b.a.org/x?/x/y": ("b.a.org", "/x", "b.a.org/x", "block"),
        "//a.org/x": ("", "", None, "allow"), "http://ba.org/x": ("ba.org", "/x", "org/", "allow"), "http://a.org": ("a.org", "", None, "allow"), "http://a.org.com/x": ("a.org.com", "/x", None, "allow"),
        "x://y://a.org/x": ("y:", "//a.org/x", None, "allow"), "http://org/x": ("org", "/x", "org/", "allow"), "http:///x": ("", "/x", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://-a.org/x": ("-a.org", "/x", "org/", "allow"), "http://b.a.orgx/x": ("b.a.orgx", "/x", None, "allow"), "http://a.org#x": ("a.org", "", None, "allow"), "http://.a.org/x": (".a.org", "/x", "a.org/x", "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] * 2, "page_id long, url string").withColumn("key", F.lit("z")).withColumn("stack", F.lit(1))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect())
    assert got == sorted([(i, *c) for i, c in enumerate(cases.values())] * 2)
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_hosts_of_very_many_labels(spark):
    """A host of 100,000 labels takes no longer than its length; parent domains deeper than any rule's are not looked up."""
    rules = spark.createDataFrame([("block", "b.org", "/"), ("allow", "a.b.org", "/x"), ("block", "", "/")], "verdict string, host string, path string")
    long = "x." * 100_000
    urls_ = [f"http://{long}a.b.org/x", f"http://{long}b.org/x", f"http://{long}org/", "http://b.org/", f"http://{'.' * 50_000}/", "http://a.b.org/y"]
    began = time.monotonic()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(list(enumerate(urls_)), "page_id int, url string"), rules).collect()}
    assert got == {0: ("a.b.org/x", "allow"), 1: ("b.org/", "block"), 2: (None, "allow"), 3: ("b.org/", "block"), 4: ("/", "block"), 5: ("b.org/", "block")}
    assert time.monotonic() - began < 60
    none = urls.judge_urls(spark.createDataFrame([(1, f"http://{long}org/")], "page_id int, url string"), rules.limit(0)).first()
    assert (none["rule"], none["verdict"]) == (None, "allow")


def test_many_url_rules(spark):
    """Nested hosts and paths by chance against a scan of all rules, with a hot host split."""
    r = random.Random(6)
    host = lambda k: ".".join(r.choice("abc") for _ in range(k))
    path = lambda k: "/" + "".join(r.choice(["x", "y", "/", "é", "\U0010ffff"]) for _ in range(k))
    rules = [(r.choice(["allow", "block"]), host(r.randint(1, 3)), r.choice(["", path(r.randint(0, 4))])) for _ in range(150)]
    pages = [(i % 700, f"http://{host(r.randint(1, 4))}{r.choice(['', path(r.randint(0, 7))])}{r.choice(['', '?x', '#y'])}") for i in range(1500)]
    pages += [(i, "http://a.b/xx") for i in range(300)]
    best = {}
    for v, h, p in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    want = []
    for i, u in pages:
        m = re.match(r"http://([^/?#]*)([^?#]*)", u)
        fits = [(len(h) + len(p), len(h), h, p, v) for (h, p), v in best.items() if (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        want.append((i, m[1], m[2], *((lambda b: (b[2] + b[3], b[4]))(max(fits)) if fits else (None, "allow"))))
    df = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"), sweep_rows=40)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_preference(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yo"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", None, None, None), (3, "rejected", 0, "assistant", "é"), (None, "chosen", 0, "user", "x"),
        (4, "chosen", 0, "user", "a"), (4, "rejected", 0, "user", "a"), (4, "rejected", 1, "assistant", "b"),
        (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string").withColumn("prompt", F.lit(1))
    got = {r["pair_id"]: tuple(r)[1:] for r in chat.preference_pairs(df).collect()}
    assert got[1] == (1, "<|user|>\nhi\n", "<|assistant|>\nyo\n", "<|assistant|>\nno\n", "14:16", "14:16")
    assert got[2] == (0, "", "<||>\n\n", None, "", None)
    assert got[3] == (0, "", None, "<|assistant|>\né\n", None, "14:15")
    assert got[4] == (1, "<|user|>\na\n", "", "<|assistant|>\nb\n", "", "14:15")
    assert got[5] == (1, "<|user|>\na\n", "<|user|>\na\n", "", "", "")
    assert set(got) == {1, 2, 3, 4, 5}
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit.upper()), (1, "  Copyright 2020 Someone\n" + mit.replace(",", " ;").replace("license", "licence") + "\n(c) me"), (2, mit + " more"), (3, None), (4, ""), (5, "Copyright 1999 x"), (None, mit), (6, mit * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("form", F.lit("y"))
    got = licenses.scan_licenses(df).collect()
    assert len(got) == 8 and {(r["doc_id"], r["license"]) for r in got} == {(1, "MIT"), (2, None), (3, None), (4, None), (5, None), (None, "MIT"), (6, None)}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_wrapped_licenses(spark):
    """Each text at every width of lines from 40 to 120, with typographic signs, with a holder and in capitals; Spark beside SQL."""
    import textwrap

    rows = []
    for name, text in licenses.KNOWN.items():
        text = text.replace("<year>", "2019").replace("<copyright holders>", "Ada Bell and others").replace("<owner>", "Ada Bell")
        for width in range(40, 121):
            whole = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in text.split("\n\n"))
            rows.append((name, whole))
            rows.append((name, whole.upper() if width % 2 else whole.replace('"', "\u201c").replace("'", "\u2019").replace("\n", "\r\n").replace("-", "\u2010")))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841 - read by the SQL
    assert dict(con.execute(f"SELECT doc_id, license FROM ({entry.SQL['op2_licenses']})").fetchall()) == got


def test_digests_of_published_texts(spark):
    import os

    here = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, open(f"{here}/{f}", encoding="utf-8").read(), name) for i, (name, f) in enumerate(files.items()) if os.path.exists(f"{here}/{f}")]
    if not rows:
        pytest.skip("no licence texts on this machine")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert got == {i: name for i, _, name in rows}
