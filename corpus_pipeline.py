"""The corpus pipeline: documents to packed sequences, one stage after another.

Each stage works on all that the stage before it kept, is written as Parquet in the shared folder and read again. All
but the last return the columns of documents. Rows without an id can't be linked, so they are never near duplicates;
rows that share an id are one document and the near-duplicate stage keeps the one whose columns have the least hash. An empty table passes through
every stage as an empty table; extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm import decontaminate, neardup, packing, pii
from foretide.llm import toxicity as tox
from foretide.llm.common import stored, table
from foretide.llm.entry import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays under the threshold."""
    return tox.clean_documents(docs, tox.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    # of rows that share an id always the same one: the least hash of all columns; equal rows are alike
    hashed = docs.where("doc_id IS NOT NULL").withColumn("row_hash", F.xxhash64(*docs.columns))
    least = hashed.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("row_hash").alias("least_hash"))
    whole = hashed.join(least, "doc_id").where("row_hash = least_hash").dropDuplicates(["doc_id"])
    return whole.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, re-parameterised ones included."""
    leaked = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Random fields, signatures and learned scores have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
