"""A corpus run: quality rules, line dedup, near-copy removal, benchmark decontamination, BPE encoding.

Every stage takes the documents its predecessor wrote and returns documents with the same columns; the last
one returns ids. Documents that fail the quality rules, near copies of a document with a smaller id, and
documents with benchmark items are left out; repeated lines are cut from the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bpe_chunks, decontaminate, lines, ngram_join, quality
from watchloom.llm.common import small_batches, table
from watchloom.llm.queries import word_bpe
from watchloom.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS), table(small_batches(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the shorter texts."""
    cut = lines.remove_repeated_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe_chunks.encode_corpus(docs, word_bpe())
    return encoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_copies", near_copies),
    ("decontamination", decontamination), ("bpe_encoding", bpe_encoding),
]
#: The tokenizer can't be expressed in SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
