import importlib
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkdrift.llm import queries

from tests.llm.test_minhash import brute


def test_registered_queries(spark, sf_dir):
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op1_line_dedup"]).fetchall()
    found = queries.op1_line_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_near_duplicates_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_minhash(spark, sf_dir).collect()}
    assert found == brute([tuple(r) for r in docs])


def test_stages_do_what_they_say(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == first
        if name in ("line_dedup", "pii"):
            assert docs.count() == before.count()
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            kept = {k for k, (_, low) in brute(rows).items() if k == low}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {
                r.doc_id for r in before.select("doc_id").collect()
            }
    assert columns == first and corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.exceptAll(docs).count() == 0 and docs.exceptAll(whole).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, "a b c d e f\ng\nh", "en", None, 5), (1, "a b c d e f\ng\nh", "en", None, 5), (None, None, None, "s", None)]
    rows += [(2, "", None, "s", 0), (3, "word " * 40_000, "de", "s", 1), (4, "A b c d e f\ng\nh", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"kept": F.lit(1), "KEY": F.lit("x"), "spans": F.lit(2.0)})
    out = stage(spark, docs, sf_dir)
    out.collect()
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
    if name != "packing":
        assert out.columns == docs.columns


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "sparkdrift.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        module = importlib.reload(__spark_entry__)
        assert "pipeline" not in module.queries() and "drift_report" in module.queries()
        assert not any(n.startswith("op") for n in module.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
