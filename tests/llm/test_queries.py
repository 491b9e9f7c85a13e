"""Registered queries next to their SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences, open_tables
from tidewatch.llm.queries import ENTRIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_equals_its_sql(spark, name):
    query, sql = ENTRIES[name]
    assert differences(query(spark, SF).toPandas(), open_tables(SF).execute(sql).df()) is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql and n != "pipeline"])
def test_a_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = ENTRIES[name][0](spark, SF)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] and docs.where(~F.col("same")).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = spark.read.parquet(str(tmp_path / "1")).join(labels, "doc_id").groupBy("quality").count().collect()
    by = {r[0]: r[1] for r in clean}
    before = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "0")).join(labels, "doc_id").groupBy("quality").count().collect()}
    assert by[1] >= 0.97 * before[1] and by.get(0, 0) <= 0.4 * before[0]


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
