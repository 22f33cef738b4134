"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import remove, scratch


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(cc_node, cc_root): the smallest node reachable from each node of edges (a, b), both long.

    Each round takes the least root among a node's neighbours and then the root of that root, so
    rounds follow the logarithm of the longest path, not its length. Minima combine on the map side,
    hubs are joins that Spark splits. Each round's table is written and read again: that cuts the plan
    for good, where a checkpoint would hand on what the optimizer knows of its columns, which doubles
    every round. A table goes once its successor is written. No edges give an empty table. A graph that
    has not settled within max_rounds is an error.
    """
    spark = edges.sparkSession

    def held(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path), path

    both, _ = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    state, last = held(both.groupBy(F.col("a").alias("cc_node")).agg(F.min("b").alias("m")).select("cc_node", F.least("cc_node", "m").alias("cc_root")))
    for _ in range(max_rounds):
        near = both.join(state, F.col("b") == F.col("cc_node")).groupBy("a").agg(F.min("cc_root").alias("m"))
        step = state.join(near, F.col("cc_node") == F.col("a"), "left").select("cc_node", F.col("cc_root").alias("old"), F.least("cc_root", "m").alias("r"))
        up = state.select(F.col("cc_node").alias("r"), F.col("cc_root").alias("rr"))
        after, path = held(step.join(up, "r", "left").select("cc_node", "old", F.least("r", "rr").alias("cc_root")))
        remove(spark, last)
        state, last = after.select("cc_node", "cc_root"), path
        if after.filter("old <> cc_root").isEmpty():
            return state
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
