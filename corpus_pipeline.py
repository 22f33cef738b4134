"""A corpus from documents to token ids: quality rules, line dedup, near duplicates, source mix, BPE.

Every stage takes all that its predecessor kept, written as Parquet and read again, so that a lost
executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, line_dedup, mixing, near_dup, quality
from marginalia.llm.base import modest_batches, remove, scratch

#: SQL cannot express the stages' sketches, bands and recursion; tests hold them against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and their group's fences."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document of smallest id. Rows of one id are one document."""
    stay = near_dup.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one that it takes twice as two rows."""
    mixed = mixing.mix_sources(docs).filter("mix_copies > 0")
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's token ids and their number, and whether they decode to the text."""
    modest_batches(spark)
    x = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, bytes_col="decoded")
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return x.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    What is between stages lies in the shared folder until the next stage is written, the last until the driver ends.
    """
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            remove(spark, f"{out}/{k - 1}")  # its successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
