"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm import alignment, decontamination, langid, license_scan, lm_score, merkle, mixing, packing, quality, secret_scan, simhash, toxicity, warc
from quakeframe.llm.oracle import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and base scores of every document."""
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived as a WARC record and read back through the capture index."""
    return warc.archive_and_read(spark, _table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, from references outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents")
    return langid.digest(langid.identify(documents, langid.learn(documents)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, from a field fitted outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")), spans=True))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, failure bits and verdict of every document."""
    return quality.digest(quality.ledger(_table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs under each version of each policy, from one stored ledger."""
    return quality.report(quality.ledger(_table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document through a fresh blob ledger."""
    return secret_scan.digest(secret_scan.scan_documents(_table(spark, sf_dir, "documents")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the sources' target weights."""
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers in every document, and how common its links are."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and whether a tampered row leads to its root."""
    return merkle.digest(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_score, op3_license_scan, op4_warc, op5_simhash, op6_langid, op7_toxicity, op8_quality_rules, op9_secret_scan, op10_source_mix, op11_alignment, op12_merkle, op13_packing, quality_ablation)}
