"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage is one operator of emberplane.llm with its effect on the documents: language ID drops
those it can't identify, exact dedup keeps one of each group of equal texts, the n-gram join one of
each group of near copies, decontamination drops holders of benchmark items; packing returns pieces.

Rows that share an id, or have none, are documents of their own: each stage decides on rows, not ids, and of equal
ones the row with the smallest id stays (nulls last). Null, empty and blank texts have no letter and go in the first
stage. Ties, very long texts and the model's limits are those of each operator. All columns of documents are passed
on, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberplane.llm import common, decontaminate, exact_dedup, jaccard, language, packing


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified without ambiguity; texts without a letter go."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return language.keep_identified(docs, train)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest id."""
    rows, key = common.keyed(docs)
    gone = exact_dedup.exact_dedup(rows.select(F.col(key).alias("doc_id"), "text")).filter("NOT kept")
    return without(docs, rows, key, gone)


def without(docs: DataFrame, rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The documents whose key is not among the doc_id of `gone`."""
    return rows.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    rows, key = common.keyed(docs)
    gone = jaccard.ngram_jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"), n=5, num=80, den=100).filter("doc_id <> component_id")
    return without(docs, rows, key, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = common.keyed(docs)
    gone = decontaminate.find_items(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, rows, key, gone)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "spaced", end_id=0, capacity=1024)


STAGES = [("language_id", identify), ("exact_dedup", dedup), ("ngram_jaccard_join", near_dedup), ("decontamination", clean), ("packing", packed)]

#: SQL has no classifier, embedding or tokenizer; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
