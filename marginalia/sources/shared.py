"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without texts, and keys alone, that are broadcast at most.
FEW, KEYS = 250_000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what the cluster names in spark.checkpoint.dir.

    A temporary folder stands in for it only where driver and executors are one process; elsewhere the
    lack of the setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="marginalia-")


_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder in the shared folder. Its removal is left to the JVM, which outlives a session that is stopped."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/marginalia-{app}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS[app])
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return _ROOTS[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is removed, whether or not its session was stopped before."""
    return f"{_root(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; its lineage ends there."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_first(few: DataFrame, many: DataFrame, on: list[Column]) -> DataFrame:
    """few joined to many rows with texts. few is written and counted, and goes to the others if it has at most FEW rows, so that texts stay where they are."""
    few = written(few)
    return (F.broadcast(few) if few.count() <= FEW else few).join(many, on)


def among(many: DataFrame, keys: DataFrame) -> DataFrame:
    """many without rows of other keys, so that their texts are not looked at; if keys are more than are broadcast, a join that follows leaves those out."""
    return many.join(F.broadcast(keys), keys.columns, "left_semi") if keys.count() <= KEYS else many


def take_place(spark: SparkSession, hidden: str, path: str) -> None:
    """Gives what was written under a hidden name its own name, in one step."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    if not name(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(name(hidden), name(path)):
        raise OSError(f"{hidden} did not become {path}")


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no folder."""
    if not exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
