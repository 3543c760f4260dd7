"""A corpus from raw documents to token files: each stage takes what its predecessor kept and is written before the next one starts.

1. quality rules: documents that the learned decision list or the base rules reject go;
2. n-gram Jaccard join: of each group of near copies the row with the smallest id stays;
3. benchmark decontamination: documents with a window of a benchmark item go;
4. mixing: documents are repeated or left out so that sources reach their target weights;
5. token output: ids of the mix in rANS-coded files; the rows say where each document starts.

Null and empty texts are too short for the first stage and go there; the second stage, by itself, keeps them, as they are
copies of nothing. Rows are documents of their own even if they share an id. Of each group that links of near copies hold together
one row stays, so at a group's ends a text may go that is a near copy only of others that go. A null id comes after all others in the choice. Repeated rows (equal id and text) count as copies of one
document. Texts may have any length. Extra columns are carried along to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.llm import decontaminate, jaccard_join, mixing, quality, token_files
from scarpline.llm.common import n_words, saved, scratch, table
from scarpline.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.fit_texts(docs, table(spark, sf_dir, "labels"))
    return quality.judged(quality.statistics(docs), rules).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(jaccard_join.components(docs).where("component is not null").select("doc_id", "key", "component"), "components")
    # A row is known by its id and a hash of its text, as one id may stand for several texts.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("stays"))
    others = found.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("stays")), "left_anti").select("doc_id", "key").distinct()
    mark = "_" * (1 + max(map(len, docs.columns)))  # a prefix that no column has
    others = others.toDF(f"{mark}id", f"{mark}key")
    same = F.col("doc_id").eqNullSafe(F.col(f"{mark}id")) & (F.col(f"{mark}text") == F.col(f"{mark}key"))
    kept = docs.withColumn(f"{mark}text", F.xxhash64("text")).join(others, same, "left_anti")
    twice = found.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key").toDF(f"{mark}id", f"{mark}key")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", f"{mark}text"])
    return kept.join(twice, same, "left_anti").unionByName(single).select(*docs.columns)


def benchmark_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = n_words(F.col("text"))
    return mixing.mixed_rows(docs, size, preference=F.sqrt(size))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.encode_corpus(docs, folder, tokenizer_path(), 2)
    return token_files.documents(spark, folder)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_windows),
    ("mixing sources to target weights", source_mix),
    ("token-ID output", token_output),
]

#: Learned rules, random ranks and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage{k + 1}")
    return docs
