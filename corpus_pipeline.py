"""A training-corpus pipeline over ``documents``: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of ``documents``; the last returns the packed pieces.

Defined results: documents without a letter, or between languages, go at the first stage,
so null and empty texts do. Of near-duplicates the smallest id stays; a null id always
does. Secrets are replaced by their kinds. The mix repeats, cuts and drops documents to
meet its sources' targets. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import catalog, langid, mixing, ngram_join, packing, secret_scan
from lodestone.session import stored


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay."""
    return langid.keep_identified(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 alike, directly or by links, one stays."""
    return ngram_join.keep_one_of_each(docs, width=5, num=80, den=100)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; the documents stay."""
    return _sized(secret_scan.redact(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _sized(mixing.mixed_documents(docs))


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, catalog.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
    ("packing", packing_windows),
]

#: Trained classifiers and packing plans have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
