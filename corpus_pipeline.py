"""A pipeline over a corpus: classify, deduplicate, decontaminate, redact and tokenize.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, decontam, near_copies, quality_classifier, secrets
from turnlake.llm.common import bounded_batches, release_memory, written

#: Bytes of an Arrow batch: the stages follow each other in the same executors, whose heaps are full by then.
BATCH_BYTES = 8 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likely junk or toxic, and those of null text. Repeated rows are judged alike; an empty table gives an empty one."""
    bounded_batches(spark, BATCH_BYTES)
    scorer = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    release_memory()  # of the fit
    return quality_classifier.classify(docs, scorer).filter("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: texts that share 80 % of their 5-word shingles.

    The one of least doc_id stays, rows without an id last. Null and blank texts are one group. An empty table gives an empty one.
    """
    bounded_batches(spark, BATCH_BYTES)
    return near_copies.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which items of the benchmark leak. Null and empty texts stay, and so do all rows if the benchmark is empty."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of secrets; n_chars follows the text, and is null for a null text, which stays. All rows are kept."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. Null and empty texts have no ids; all rows are kept."""
    bounded_batches(spark, BATCH_BYTES)
    out = bpe.bpe_encode(docs, round_trip="round_trip")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact),
    ("bpe_tokens", tokenize),
]
#: A fitted classifier, fingerprints and merges aren't SQL; the tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
