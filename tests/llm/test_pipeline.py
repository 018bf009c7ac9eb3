"""The pipeline, stage by stage, against plain versions."""

import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/root/repo")
pipeline = pytest.importorskip("corpus_pipeline")

from foretide.llm import pii, toxicity  # noqa: E402
from foretide.llm.common import table  # noqa: E402
from foretide.llm.entry import tokenizer_path  # noqa: E402

from . import test_decontaminate, test_neardup, test_packing  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    model = toxicity.train(docs, table(spark, SF, "labels"))

    one = stages["toxicity"](spark, docs, SF).cache()
    assert one.columns == columns
    plain = {r["doc_id"] for r in docs.collect() if model.score(model.sentence_scores(r["text"])) < 0.7}
    assert {r["doc_id"] for r in one.collect()} == plain and len(plain) > 800

    two = stages["near_duplicates"](spark, one, SF).cache()
    assert two.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == [d for d, _, _, kept in test_neardup.brute(rows) if kept]

    three = stages["decontamination"](spark, two, SF).cache()
    assert three.columns == columns
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, _ in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in two.collect()], items)}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - leaked and leaked

    four = stages["pii"](spark, three, SF).cache()
    assert four.columns == columns and four.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    known = pii.Emissions(pii.train(pii.labelled_examples()))
    for r in four.collect():
        ((_, spans),) = pii.all_spans([before[r["doc_id"]]], known)
        assert r["text"] == pii.redacted(before[r["doc_id"]], spans) and r["n_chars"] == len(r["text"])

    five = stages["packing"](spark, four, SF).collect()
    test_packing.check(five, [(r["doc_id"], r["text"]) for r in four.collect()])
    assert sorted(map(tuple, pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in five)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "mail a@b.cc now", None, None, 15), (3, "mail a@b.cc now", None, None, 15), (None, "text", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("sig", F.lit(2))
    for n in (docs, docs.limit(0)):
        out = n
        for _, stage in pipeline.STAGES:
            out = stage(spark, out, "/root/testdata/sf0.001")
        got = out.collect()
        assert sorted((r["doc_id"] for r in got), key=str) == ([1, 2, 3, None, None] if n is docs else [])
    assert tokenizer_path()
