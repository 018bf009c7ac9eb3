"""Every query with SQL against DuckDB, the rest for rows; the driver's entry point."""

import os
import subprocess
import sys

import duckdb
import pytest

from foretide import method_sql, panel_queries, product_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    return sorted((tuple(round(v, 3) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert plain(df.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """A copy without the training-data folders, with and without the pipeline's file, lists and plans the other queries."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = [f"{repo}/foretide", f"{repo}/__spark_entry__.py"] + ([f"{repo}/corpus_pipeline.py"] if pipeline and os.path.exists(f"{repo}/corpus_pipeline.py") else [])
    subprocess.run(["cp", "-r", *files, str(tmp_path)], check=True)
    if (tmp_path / "foretide/llm").exists():
        (tmp_path / "foretide/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; from pyspark.sql import SparkSession as S; s = S.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print(len(e.queries()), len(e.oracle_sql()), len(e.entry(s).columns))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.SQL)), "4"], out.stderr
