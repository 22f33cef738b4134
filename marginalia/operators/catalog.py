"""Catalog of courses, blocks and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import ColumnOrName, _c, block_number, subject_and_block, text


def natural_key(x: ColumnOrName, none: int = 10_000) -> Column:
    """struct to sort names by: the first number in it, then the name in lower case, then the name."""
    n = F.coalesce(F.regexp_extract(text(x), r"(?U)\d+", 0).try_cast("bigint"), F.lit(none))
    return F.struct(n.alias("n"), F.lower(_c(x)).alias("l"), _c(x).alias("x"))


def course_blocks(rows: DataFrame) -> DataFrame:
    """rows (store, course, block) to store, course_name, blocks: the distinct names with the word block, in natural order."""
    x = rows.filter(F.lower("block").contains("block")).select("store", "course", "block").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(natural_key("block"))), lambda s: s["x"])
    return x.groupBy("store", F.col("course").alias("course_name")).agg(ordered.alias("blocks"))


def records(documents: DataFrame) -> DataFrame:
    """documents (document_id, store_path) with subject, block."""
    return documents.withColumn("sb", subject_and_block("store_path")).select("*", "sb.*").drop("sb")


def complete(documents: DataFrame, *parts: DataFrame) -> DataFrame:
    """Documents that every part (document_id) has."""
    for p in parts:
        documents = documents.join(p.select("document_id").distinct(), "document_id", "left_semi")
    return documents


def distinct_labels(files: DataFrame) -> DataFrame:
    """files (folder, path, stem, label) with labels made distinct within a folder.

    The first path of a label keeps it; the others append their block number, or else their stem.
    """
    nth = F.row_number().over(Window.partitionBy("folder", "label").orderBy("path"))
    other = F.concat(F.col("label"), F.lit("_"), F.upper(block_number("stem")))
    return files.withColumn("nth", nth).withColumn("label", F.when(F.col("nth") > 1, other).otherwise(F.col("label"))).drop("nth")


def reconcile(truth: DataFrame, held: DataFrame) -> DataFrame:
    """held (document_id, label, store_path) set to what truth (document_id, label, store_path) says, with changed.

    Documents that truth does not know stay as they are.
    """
    t = truth.select(F.col("document_id").alias("t_id"), F.col("label").alias("t_label"), F.col("store_path").alias("t_path"))
    x = held.join(t, F.col("document_id") == F.col("t_id"), "left")
    new = {"label": F.coalesce("t_label", "label"), "store_path": F.coalesce("t_path", "store_path")}
    x = x.withColumn("changed", ~(new["label"].eqNullSafe(F.col("label")) & new["store_path"].eqNullSafe(F.col("store_path"))))
    return x.withColumns(new).drop("t_id", "t_label", "t_path")


def union(**stores: DataFrame) -> DataFrame:
    """store, then the columns of the stores' catalogs, one behind the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.select(F.lit(name).alias("store"), "*") for name, x in stores.items()])


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The different values of a column that are neither null nor empty."""
    return rows.filter(text(column) != "").select(column).distinct()


def totals(documents: DataFrame) -> DataFrame:
    """One row about the catalog: total_documents, chunks and words of all."""
    return documents.agg(F.count("*").alias("total_documents"), F.sum("total_chunks").alias("total_chunks"), F.sum("total_words").alias("total_words"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """document_id, total_chunks, total_words."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("total_chunks"), F.sum("word_count").alias("total_words"))


def outcomes(results: DataFrame) -> DataFrame:
    """results (error) counted: successes and failures."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("successes"), F.count_if(F.col("error").isNotNull()).alias("failures"))
