"""Corpus pipeline: quality classifier, near-duplicate join, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import anchors, jaccard, line_crf, packing, secrets
from evalspark.llm.common import kept_table, table
from evalspark.scaling import shared_folder


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    model = line_crf.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return line_crf.score(docs, model, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of documents that share 80 % of their 5-word shingles: that with the smallest doc_id."""
    return jaccard.one_of_each(docs, percent=80, size=5)


def substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without passages of 20 words that stand earlier in the corpus; those left empty go."""
    return anchors.without_repeats(docs)


def secrets_out(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    path = shared_folder(spark, "llm-ledger")
    # The stages before have left one of each group of copies.
    secrets.update_ledger(docs, path, known=False, copies=False)
    return secrets.redact(docs, path)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("secret_scans", secrets_out),
    ("packing", pack),
]

# A trained classifier is not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, folder), f"pipeline-{name}")
    return docs


