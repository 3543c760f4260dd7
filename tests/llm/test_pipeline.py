"""The pipeline's stages: what each keeps, and that all but the last keep the columns."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scarpline.llm import decontaminate, jaccard_join

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        out[name] = docs
    rules, single, clean, mixed = out.values()
    assert 0 < rules.count() < before.count()
    components = {r.doc_id: r.component_id for r in jaccard_join.components(rules).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted({v for v in components.values()})
    hits = decontaminate.decontaminate(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in hits.where("n_hit = 0").collect())
    assert mixed.select("doc_id").distinct().count() <= clean.count() and mixed.join(clean, "doc_id", "left_anti").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert last.count() == mixed.count()
    ends = last.agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).first()
    assert ends["n"] == ends["end"]


def test_repeated_and_null_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z"), (None, "z"), (3, None), (3, None)], "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, rows, SF)
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "3", "None"]


def test_one_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (None, b, 4), (None, a + " x y z u v", 5)], "doc_id long, text string, _key int")
    kept = corpus_pipeline.near_copies(spark, rows, SF)
    assert sorted(r["_key"] for r in kept.collect()) == [1, 3, 5] and kept.columns == rows.columns


@pytest.mark.parametrize("k", range(4))
def test_stages_of_empty_tables_and_extra_columns(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    wide = docs.select("*", *(F.lit(7).alias(c) for c in ("key", "size", "component", "copies", "spans", "n_words", "kept", "target", "_text")))
    assert stage(spark, wide.limit(0), SF).count() == 0
    long = wide.withColumn("text", F.when(F.col("doc_id") == 1, F.repeat("text", 200)).otherwise(F.col("text")))
    assert stage(spark, long, SF).columns == wide.columns
