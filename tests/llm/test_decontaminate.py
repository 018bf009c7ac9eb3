"""Decontamination against a plain version, and re-parameterised questions."""

import random
import re

from pyspark.sql import functions as F

from foretide.llm import decontaminate
from foretide.llm import decontaminate as d
from foretide.llm.common import table


#: Plain forms of what a word is; slow on long words.
NUMBER = re.compile(r"[^\w]*[0-9][0-9.,:/]*([^\W\d_]{0,3})(%?)[^\w]*\Z")
NAME = re.compile(r"[^\w]*[^\W\d_a-zà-öø-ÿ][a-zà-öø-ÿ]+[^\w]*\Z")
ENDS = re.compile(r"[.!?:][^\w]*\Z")


def tokens(text):
    """(word or slot type, is a slot, value) of a text, word by word."""
    out, opens, before = [], True, None
    for w in (text or "").encode().split():
        w = w.decode()
        plain, unit = re.sub(r"[\W_]+", "", w).lower(), 0
        if m := NUMBER.match(w):
            kind, unit = "#", d.UNITS["%"] if "%" in w[m.end(1) :] else d.UNITS.get(m[1].lower(), 0)
        elif plain in d.UNITS or w == "%":
            kind, unit = "u", d.UNITS[plain or "%"]
        elif NAME.match(w):
            kind = "N"
        else:
            kind = "w" if plain else ""
        if w == "%":
            plain = "%"
        if kind:
            if kind == "#" or kind == "u" and before == "#":
                t = "#"
            elif kind == "N" and not opens:
                t = "N"
            else:
                t = "w"
            if t != "w" and out and out[-1][0][:1] == t and out[-1][1]:
                out[-1][2].append(plain)
                if unit:
                    out[-1][0] = f"#{unit}"
            else:
                out.append([(f"#{unit}" if t == "#" else t) if t != "w" else plain, t != "w", [plain]])
            before = kind
        opens = bool(ENDS.search(w))
    return [(a, s, tuple(v)) for a, s, v in out]


def wins(ts, width):
    for i in range(len(ts) - width + 1):
        part = ts[i : i + width]
        if sum(not s for _, s, _ in part) >= d.LEAST_WORDS:
            yield i, tuple((a, s) for a, s, _ in part), [v for _, s, v in part if s]


def brute(docs, items):
    item = {}
    for i, t in items:
        ts = tokens(t)
        width = min(d.WINDOW, len(ts))
        if width >= d.LEAST_WORDS:
            item[i] = list(wins(ts, width))
    where = {}
    for i, ws in item.items():
        for at, h, v in ws:
            where.setdefault(h, []).append((i, at, v))
    widths, out = {len(h) for h in where}, set()
    for doc, t in docs:
        ts, lines = tokens(t), {}
        for width in widths:
            for at, h, v in wins(ts, width):
                for i, iat, iv in where.get(h, []):
                    lines.setdefault((i, at - iat), []).append((iat, list(zip(iv, v))))
        for (i, _), hits in lines.items():
            pairs = {p for _, ps in hits for p in ps}
            if len({a for a, _ in hits}) >= d.LEAST_COVER * len(item[i]) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                out.add((doc, i))
    return out


def run(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}


def test_documents(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    got = run(docs, items)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert len(got) >= 20


def test_other_parameters(spark):
    items = [(1, "A train leaves the old station at 40 km and meets Anna Bell near the bridge after 3 hours on the road."), (2, "One short item here."), (3, None), (4, ""), (1, "A train leaves the old station at 40 km and meets Anna Bell near the bridge after 3 hours on the road.")]
    same = "a train leaves the old station at {} km and meets {} near the bridge after {} hours on the road."
    docs = [
        (1, "Well, then: " + same.format(75, "Omar", 9) + " How far did it go?"),
        (2, same.format(75, "Omar", 75)),  # two numbers of the item become one, but the units differ
        (3, "nothing to see here at all"), (4, None), (5, ""), (6, "one short item here, and more"), (7, "a train leaves the old"), (None, same.format(1, "Eve", 2)),
    ]
    r = random.Random(1)
    for i in range(100, 160):
        ws = (r.choice(docs)[1] or "x").split()
        r.random() < 0.5 and ws.insert(r.randint(0, len(ws)), r.choice(["new", "7", "Bob", "km", "%"]))
        docs.append((i, " ".join(r.choice(["w", "Xy", "5"]) for _ in range(r.randint(0, 9))) + " " + " ".join(ws)))
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("id", F.lit(1))
    got = run(dd, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    assert got == {p for p in brute(docs, items) if p[0] is not None}
    assert (1, 1) in got and (6, 2) in got and not any(x[0] in (3, 4, 5, 7) for x in got)
    assert run(dd.limit(0), dd.select(F.col("doc_id").alias("item_id"), "text")) == set()
    assert run(dd, spark.createDataFrame([], "item_id long, text string")) == set()


def test_clashing_slots(spark):
    item = "the price of 5 apples and 7 pears in the small shop is 5 coins for each of them today"
    ok = "the price of 2 apples and 3 pears in the small shop is 2 coins for each of them today"
    bad = "the price of 2 apples and 3 pears in the small shop is 9 coins for each of them today"
    docs = spark.createDataFrame([(1, ok), (2, bad)], "doc_id long, text string")
    assert run(docs, spark.createDataFrame([(8, item)], "item_id long, text string")) == {(1, 8)}


def test_broken_in_the_middle(spark):
    words = "how many small green boats would cross this wide river before every other sailor had seen their first cold winter morning there".split()
    added, gone = words[:11] + ["really"] + words[11:], words[:11] + words[12:]
    long = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(1, " ".join(added)), (2, " ".join(gone)), (3, " ".join(["so"] + long[20:45] + ["it", "goes"])), (4, " ".join(words[:9] + long[:3])), (5, " ".join(long[20:32]))]
    items = [(1, " ".join(words)), (3, " ".join(long))]
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == {(1, 1), (2, 1), (3, 3)}


def test_values_that_meet(spark):
    item = "the price of {} apples and {} pears in the small shop was paid with {} coins from the green box on day {} of spring"
    docs = [(1, item.format(7, 7, 4, 9)), (2, item.format(5, 7, 8, 6)), (3, item.format(1, 2, 3, 4))]
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item.format(5, 7, 4, 9)), (2, item.format(5, 7, 8, 8))], "item_id long, text string")) == {(1, 1), (2, 1), (2, 2), (3, 1)}


def test_items_without_windows(spark):
    items = [(1, "What is 17 * 23 + 4?"), (2, "Solve 3x + 5 = 20 for x."), (3, "\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u5ea6\uff1f"), (4, "?!"), (5, None)]
    docs = [(1, "Now: what is 17 * 23 + 4? Tell."), (2, "what is 17 * 23 + 45?"), (3, "what is 17 * 23 - 4?"), (4, "Please solve  3x + 5 = 20 for x"), (5, "\u95ee\uff1a\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u5ea6\u5462"), (6, "\u6c34\u7684\u6cb8\u70b9\u662f"), (7, None), (8, "")]
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == {(1, 1), (4, 2), (5, 3)}


def test_items_too_short_to_search(spark):
    items = [(1, "Yes"), (2, "Paris?"), (3, "a"), (4, "42"), (5, None), (6, "What is 17 * 23 + 4?"), (7, ITEM_OF_WORDS), (8, "\u4e3a\u4ec0\u4e48"), (9, "?!"), (10, "12 bytes, so!!")]
    docs = [(1, "I said yes to the man in Paris."), (2, "A yes is a yes."), (3, "It is 42 a day."), (4, "So, what is 17*23+4?"), (5, ITEM_OF_WORDS), (6, "\u4e3a\u4ec0\u4e48"), (7, "I read 12 bytes, so!")]
    items = spark.createDataFrame(items, "item_id long, text string")
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), items) == {(4, 6), (5, 7)}
    assert sorted(r["item_id"] for r in decontaminate.unsearchable(items).collect()) == [1, 2, 3, 4, 5, 8, 9, 10]


ITEM_OF_WORDS = "which river runs from the black forest to the sea"


def test_hot_ends_are_salted(spark, monkeypatch):
    """One item verbatim in very many documents, and an item whose start all of them hold."""
    items = spark.createDataFrame([(1, "What is 17 * 23 + 4?"), (2, "What is 17 * 23 + 4? And 5 - 2?")], "item_id long, text string")
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('So: what is 17 * 23 + 4?', IF(id % 3 = 0, ' And 5 - 2?', ' Nothing.')) AS text")
    want = {(i, 1) for i in range(300)} | {(i, 2) for i in range(0, 300, 3)}
    assert run(docs, items) == want
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 20)
    assert run(docs, items) == want


def test_long_words_take_linear_time():
    import time

    start = time.time()
    for word in ("." * 1_000_000, "1" + "." * 1_000_000 + "x", "A" + "b" * 1_000_000 + "-" * 1_000_000 + "_", "9,:" * 300_000 + "kmx1", "!" * 999_999 + "a"):
        decontaminate.kind_of(word)
    assert time.time() - start < 20


def test_kinds_of_words():
    kinds = {w: decontaminate.kind_of(w)[0] for w in ("12", "(3.5)", "5kg,", "1/2", "7_", "Ada", "Ada's", "(Bo)", "ada", "km", "%", "--", "B2", "12abcd", "12%", "Él")}
    one, unit, name, word, none = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME, decontaminate.WORD, decontaminate.NOTHING
    assert kinds == {"12": one, "(3.5)": one, "5kg,": one, "1/2": one, "7_": word, "Ada": name, "Ada's": word, "(Bo)": name, "ada": word, "km": unit, "%": unit, "--": none, "B2": word, "12abcd": word, "12%": one, "Él": name}
    assert decontaminate.kind_of("5kg")[2] == decontaminate.kind_of("lbs")[2] != decontaminate.kind_of("km.")[2] > 0 and decontaminate.kind_of("end.)")[3]


def test_dimensions_are_told_apart(spark):
    item = "a rope of 12 meters hangs from the old tower while a bell of 30 kg swings slowly beside it"
    same, other = item.replace("12 meters", "9 feet").replace("30 kg", "44 lbs"), item.replace("12 meters", "9 hours").replace("30 kg", "5 %")
    item, same, other = (t.replace("meters", "m") for t in (item, same, other))
    docs = spark.createDataFrame([(1, same), (2, other)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def test_hot_windows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 3)
    item = "how many blue birds sit on the roof of the red barn when the farmer comes home"
    docs = spark.createDataFrame([(i, f"{item} number {i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item + " again")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, i) for d in range(40) for i in (1, 2)]
