"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Documents with toxic content go; one document of each group of near-duplicates stays; documents that hold a benchmark
item go; secrets are masked in the text; the rest is mixed to the sources' target weights.

Defined results: rows are judged by their content and told apart by all their columns, so that null and repeated ids
take part in every stage: of rows that are equal in all columns one is kept by the second stage. Null and empty texts
are clean, are near-duplicates of each other, hold no benchmark item and no secret, and have no word that the mix
could take. Other columns go through unchanged; the last stage adds mix_shard, mix_copy and mix_order. An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm import decontamination, mixing, secret_scan, simhash, toxicity
from quakeframe.llm.common import scratch, scratch_removed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the field is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (items of under five tokens are no evidence)."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document that the mix takes, with its shard and order there."""
    return mixing.draw(docs, mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: A conditional random field is not SQL: tests/llm compares every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents of ``sf_dir``. What a stage leaves in the shared folder beside its result is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with scratch_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
