"""Writers. Tables are replaced by document, appended once, or rebuilt whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.store import last_wins
from marginalia.sources.shared import exists


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of the columns that schema names, unless there is a table."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def replace_documents(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Replaces the folders of the documents in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Appends the rows whose keys are not there, so that a second run adds nothing; null is a key like others."""
    spark = df.sparkSession
    if exists(spark, path):
        held = spark.read.parquet(path).select(*[F.col(k).alias(f"held_{n}") for n, k in enumerate(keys)]).distinct()
        df = df.join(held, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"held_{n}")) for n, k in enumerate(keys)]), "left_anti")
    df.dropDuplicates(list(keys)).write.mode("append").parquet(path)


def master_index(documents: DataFrame, path: str, order: str) -> None:
    """The catalog of this run, the last row of a document counts."""
    last_wins(documents, "document_id", order).drop(order).write.mode("overwrite").parquet(path)


def raw_text(page_rows: DataFrame, path: str) -> None:
    """A line of JSON for each file: its pages by number, counted from one, and the full text."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    x = page_rows.filter("error IS NULL").groupBy(F.col("path").alias("source_pdf")).agg(rows.alias("r"))
    x.select(
        "source_pdf", F.size("r").alias("total_pages"), F.array_join(F.transform("r", lambda s: s["text"]), "\n\n").alias("full_text"),
        F.map_from_entries(F.transform("r", lambda s: F.struct(s["page_no"].cast("string"), s["text"]))).alias("pages")).write.mode("overwrite").json(path)


def sheet_csv(sheet: DataFrame, path: str) -> None:
    """A sheet with headings and quoted fields."""
    sheet.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
