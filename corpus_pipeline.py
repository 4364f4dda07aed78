"""A corpus through quality rules, near-dedup, decontamination, secret scans and tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; the result is
written as Parquet to the shared folder and read again as the next one's input. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duochron.llm import bpe, contamination, quality, secrets, simhash
from duochron.llm.common import discard, stored
from duochron.llm.plans import table, tokenizer_file

TABLES = 60_000  # entries of each of the tokenizer's tables: the stages before it have filled the executor's heap


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie too far from their language's reference go."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest id. SimHash over
    shingles of five words, four of 64 bits: copies with few edits for their length. Pairs near a
    similarity of 0.8 differ in some ten bits and stay; see the README."""
    return simhash.one_of_each(docs, "doc_id", "text", shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows the text. No document goes."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digest of the text decoded from them."""
    path = tokenizer_file("word_bpe_49k.json")
    out = bpe.coded(docs.select("doc_id", "text"), ["doc_id"], "text", path, most=TABLES)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_tokens", tokens),
]

# Hashing, base64 decoding and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # its only reader is written
        before = docs
    return docs
