"""A table in ranges of its order with a directory of their ranks, so that any page is a look into one or two ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.shared import exists

#: Rows of a range, about.
RANGE_ROWS = 100_000


def write(df: DataFrame, path: str, order: tuple[str, ...], range_rows: int = RANGE_ROWS) -> None:
    """Writes df to path in ranges of the order, which must be total, and notes the number of rows in each.

    Rows are sorted by ranges in tasks of their own; the directory has a row a range. A table that is there is added
    to: its rows must come before the new ones in the order, as rows of a log do.
    """
    spark = df.sparkSession
    if "rank_range" in df.columns:
        raise ValueError("rank_range is the name of the directory's column")
    first = 0
    if exists(spark, f"{path}/directory"):
        first = spark.read.parquet(f"{path}/directory").agg(F.max("rank_range")).first()[0] + 1
    n = df.count()
    if not n and first:
        return
    ranges = max(1, math.ceil(n / range_rows))
    x = df.repartitionByRange(ranges, *order) if ranges > 1 else df.coalesce(1)
    x = x.sortWithinPartitions(*order).withColumn("rank_range", (F.spark_partition_id() + first).cast("long"))
    x.write.mode("append").partitionBy("rank_range").parquet(f"{path}/rows")
    added = spark.read.parquet(f"{path}/rows").filter(F.col("rank_range") >= first) if n else spark.createDataFrame([], "rank_range long")
    added.groupBy(F.col("rank_range").cast("long").alias("rank_range")).agg(F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{path}/directory")


def ranges_of(spark: SparkSession, path: str, offset: int, limit: int, newest_first: bool = True) -> tuple[list[int], int]:
    """The ranges that hold the rows from offset on, at most limit of them, and how many rows of these come before; the directory is read only."""
    directory = sorted((r["rank_range"], r["n"]) for r in spark.read.parquet(f"{path}/directory").collect())
    wanted, skip, before = [], 0, 0
    for at, n in reversed(directory) if newest_first else directory:
        if before + n > offset and before < offset + limit:
            skip = skip if wanted else offset - before
            wanted.append(at)
        before += n
    return wanted, skip


def page(spark: SparkSession, path: str, order: tuple[str, ...], offset: int = 0, limit: int = 25, newest_first: bool = True) -> DataFrame:
    """limit rows from offset on in the order, or in its reverse; only the ranges that hold them are read."""
    wanted, skip = ranges_of(spark, path, offset, limit, newest_first)
    keys = [F.desc(c) if newest_first else F.asc(c) for c in order]
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("rank_range").isin(wanted or [-1]))
    return rows.orderBy(*keys).offset(skip).limit(limit).drop("rank_range")
