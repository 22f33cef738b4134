"""Numbers of rows in a total order, without one task that holds them all."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.sources.shared import written

#: Rows that one task numbers, and bytes of their texts, about.
ROWS_A_TASK, BYTES_A_TASK = 1_000_000, 1 << 26


def numbered(df: DataFrame, order: tuple[str, ...], name: str, rows_a_task: int = ROWS_A_TASK, bytes_a_task: int = BYTES_A_TASK) -> DataFrame:
    """df with the place of each row in the order, from 1; rows that are equal in it come in any order, nulls first.

    There are as many ranges of the order as the number of rows and the length of their texts ask for, cut by Spark's sample, if need be inside
    rows that are equal. A range is sorted and written as it is, each row with its place in it; the counts of the
    ranges before are added. Where the cuts lie has no bearing on the numbers.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("bigint") for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(reduce(Column.__add__, texts, F.lit(0))), F.lit(0))).first()
    ranges = max(math.ceil(n / rows_a_task), math.ceil(size / bytes_a_task))
    if ranges <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    x = df.withColumn("nb_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "nb_tie").sortWithinPartitions(*order, "nb_tie")
    x = written(x.withColumn("nb_at", F.monotonically_increasing_id()).drop("nb_tie")).withColumn("nb_range", F.shiftright("nb_at", 33))
    before = Window.orderBy("nb_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = x.groupBy("nb_range").agg(F.count("*").alias("nb_n"), F.min("nb_at").alias("nb_first"))
    ends = ends.select("nb_range", (F.coalesce(F.sum("nb_n").over(before), F.lit(0)) - F.col("nb_first") + 1).alias("nb_add"))
    return x.join(F.broadcast(ends), "nb_range").withColumn(name, F.col("nb_at") + F.col("nb_add")).drop("nb_range", "nb_at", "nb_add")
