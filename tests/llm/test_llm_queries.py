"""The registered corpus queries against SQL or plain versions, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

from compare import DATA, rows, sql_rows
from tidegauge.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, DATA)) == sql_rows(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_embedding_whitening"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES[name](spark, DATA)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars > 50")
    got = QUERIES["op6_language_id"](spark, DATA).filter("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        if i < 4:
            assert out.columns == docs.columns
        if i in (0, 2):
            assert 0 < out.count() < before
        docs, before = out, out.count()
    assert docs.filter("not lossless").isEmpty() and docs.count() > 0
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_whitened_vectors(spark):
    got = QUERIES["op13_embedding_whitening"](spark, DATA)
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got.groupBy("component").count().collect() and {r["count"] for r in got.groupBy("component").count().collect()} == {n}
    assert got.agg(F.max("identity_error")).first()[0] < 1e-6
