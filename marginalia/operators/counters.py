"""Counters and states of sessions, kept up from a log by what is new in it.

A refresh sums up the part of the log behind the last one, a row a session that has events there, and adds it
as one piece named by the highest number it holds. Such rows add up like the events that they stand for, so
nothing that was summed up before is read again; compact() puts pieces together now and then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.shared import names, remove, take_place

#: A row: a session's number of questions and last status in a stretch of the log.
ROW = "session_id string, seq bigint, n bigint, status string, status_seq bigint"


def _pieces(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Highest number and name of the pieces that count: the newest base, and what came after it."""
    found = [(int(n.partition("=")[2]), n) for n in names(spark, path) if n.startswith(("piece=", "base="))]
    base = max((upto for upto, n in found if n.startswith("base=")), default=-1)
    return sorted((upto, n) for upto, n in found if (n.startswith("base=") and upto == base) or upto > base)


def upto(spark: SparkSession, path: str) -> int:
    """The highest number of the log that is summed up, -1 before the first refresh."""
    return max((at for at, _ in _pieces(spark, path)), default=-1)


def _summed(rows: DataFrame) -> DataFrame:
    """rows of ROW, one a session."""
    said = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("status_seq"))).alias("status")
    return rows.groupBy("session_id").agg(F.max("seq").alias("seq"), F.sum("n").alias("n"), said, F.max(F.when(F.col("status").isNotNull(), F.col("status_seq"))).alias("status_seq")).select("session_id", "seq", "n", "status", "status_seq")


def _add(rows: DataFrame, path: str, name: str) -> None:
    hidden = f"{path}/_{uuid.uuid4().hex}"
    rows.write.parquet(hidden)
    take_place(rows.sparkSession, hidden, f"{path}/{name}")


def refresh(events: DataFrame, path: str) -> int:
    """Takes what is new in the log (session_id, seq, n, status) into the counters at path; the number of sessions it touched.

    seq numbers the log's rows in the order in which they were appended, from 0; the filter on it reaches the
    scan, so that files of old rows are passed over. Nothing new changes nothing, and a refresh that was cut off
    leaves no trace. Null n is none; rows of null session_id or seq do not count.
    """
    spark = events.sparkSession
    new = events.filter((F.col("seq") > upto(spark, path)) & F.col("session_id").isNotNull())
    rows = new.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"), "status", F.col("seq").cast("long").alias("status_seq"))
    hidden = f"{path}/_{uuid.uuid4().hex}"
    _summed(rows).write.parquet(hidden)
    found = spark.read.schema(ROW).parquet(hidden).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    if not found["n"]:
        remove(spark, hidden)
        return 0
    take_place(spark, hidden, f"{path}/piece={found['last']}")
    return found["n"]


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The counters' rows, some a session; store.progress() takes them as it takes events."""
    found = [f"{path}/{n}" for _, n in _pieces(spark, path)]
    return spark.read.schema(ROW).parquet(*found) if found else spark.createDataFrame([], ROW)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, seq (the last), n (the sum), status (the last)."""
    return _summed(rows(spark, path)).drop("status_seq")


def compact(spark: SparkSession, path: str) -> None:
    """Puts all pieces together; readers see the old ones or the new one."""
    old = _pieces(spark, path)
    if len(old) > 1:
        _add(_summed(rows(spark, path)), path, f"base={old[-1][0]}")
        for _, name in old:
            remove(spark, f"{path}/{name}")
