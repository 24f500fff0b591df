"""A training corpus from the table ``documents``: five stages, each on all that the one
before has kept, each written as Parquet to shared storage and read again.

1. Quality rules: documents that the standing policy rejects go.
2. Near-duplicates (five-word shingles, similarity 0.8): one document of each group stays.
3. Byte strings of 50 and more that repeat across documents stay in one place only.
4. Benchmark decontamination: spans of words that belong to benchmark windows go.
5. Byte-pair encoding; the ids are decoded again and the decoded text is hashed.

Every stage but the last returns the columns it got, with ``n_chars`` brought up to date
where the text has changed.  Null texts, empty tables and repeated rows follow the
operators' own definitions (a null or empty text fails the quality rules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import bpe, decontaminate, near_dup, quality_rules, suffix_dedup
from gridlake.llm.tables import cut, table


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(suffix_dedup.remove_repeats(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate.remove_spans(decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.tokenizer_file())
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids",
                          "decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

#: SQL has no byte-pair encoding; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
