"""Models' answers as a table by key, so that a prompt is asked once.

A prompt's key is a hash of the model's name and the text. What the table does not hold yet is written
down first; tasks then ask for it batch by batch and put each batch's answers into a file of the table
before the next batch is asked. So a plan that is read twice reads one answer, a lost executor repeats at
most the batch that it was asking for, and a run that was killed goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.names import cleared
from marginalia.sources.shared import exists, scratch

Model = Callable[[str, list[str]], list[str]]

#: A row of the table: the prompt's key, the model, its answer, and whether that stands for a failure.
ANSWER = "key string, model_id string, answer string, failed boolean"
_FILE = pa.schema([("key", pa.string()), ("model_id", pa.string()), ("answer", pa.string()), ("failed", pa.bool_())])


def key(model_id: Column, prompt: Column) -> Column:
    """SHA-256 of model and prompt; a null prompt is the empty one, a null model one of its own."""
    name = F.coalesce(F.concat(F.length(model_id).cast("string"), F.lit(":"), model_id), F.lit("-"))
    return F.sha2(F.concat(name, F.lit("\n"), F.coalesce(prompt, F.lit(""))), 256)


def answers(spark: SparkSession, store: str) -> DataFrame:
    """The table's rows, one a key: of several an answer before a failure."""
    if not exists(spark, store):
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(ANSWER).parquet(store)
    return rows.groupBy("key").agg(F.min(F.struct("failed", "answer", "model_id")).alias("a")).select("key", "a.model_id", "a.answer", "a.failed")


def _asked(model: Model, ids: list[str], texts: list[str]) -> tuple[list[str | None], list[bool]]:
    """The answers to texts, by model; one that fails gives a tagged text for all of its texts."""
    said: list[str | None] = [None] * len(ids)
    failed = [False] * len(ids)
    for one in dict.fromkeys(ids):
        at = [k for k, i in enumerate(ids) if i == one]
        try:
            for k, a in zip(at, model(one, [texts[k] or "" for k in at]), strict=True):
                said[k] = a
        except Exception as e:  # a provider's failure is an answer like any other
            for k in at:
                said[k], failed[k] = f"<Question>Model '{one}' failed: {e}</Question><Answer>N/A</Answer>", True
    return said, failed


def _asker(model: Model, store: str, batch_rows: int, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(store)
        fs.create_dir(folder, recursive=True)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                keys = batch.column("key").to_pylist()
                name = f"{run}-{hashlib.sha256(''.join(keys).encode()).hexdigest()[:40]}.parquet"
                if fs.get_file_info(f"{folder}/{name}").type == pa.fs.FileType.NotFound:  # else this task was here before it was lost
                    ids = batch.column("model_id").to_pylist()
                    said, failed = _asked(model, ids, batch.column("prompt").to_pylist())
                    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    pa.parquet.write_table(pa.table([keys, ids, said, failed], schema=_FILE), hidden, filesystem=fs)
                    fs.move(hidden, f"{folder}/{name}")  # at once there as a whole
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(keys)], pa.int64())})

    return ask_all


def ask(prompts: DataFrame, model: Model, store: str | None = None, prompt: str = "prompt", model_col: str = "model_id", out: str = "output", batch_rows: int = 64, tasks: int | None = None) -> DataFrame:
    """prompts with the model's answers in out; model(id, texts) answers the texts of one id.

    Models are asked at once, not when the result is read, each different prompt once: equal ones share the
    answer. store is a folder of the shared file system that keeps answers from run to run; without one they go
    when the driver ends. A failure becomes a tagged text; the next run with the store asks for it again.
    batch_rows prompts are asked for and kept together, by tasks at the same time. A column called out gives
    way. Where Spark runs a task twice at a time (speculation), its batch may be asked twice; one answer stays.
    """
    spark, store = prompts.sparkSession, store or scratch(prompts.sparkSession, "answers")
    prompts, back = cleared(prompts, (out,), (prompt, model_col), "an_")
    x = prompts.withColumn("an_key", key(F.col(model_col), F.col(prompt)))
    wanted = x.select(F.col("an_key").alias("key"), F.col(model_col).alias("model_id"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
    new = wanted.join(answers(spark, store).filter("NOT failed").select("key"), "key", "left_anti")
    pending, run = scratch(spark, "prompts"), uuid.uuid4().hex[:12]
    new.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "key").write.parquet(pending)  # what a task asks for stays the same if it is run again
    spark.read.parquet(pending).mapInArrow(_asker(model, store, batch_rows, run), "n bigint").agg(F.sum("n")).collect()
    said = answers(spark, store).select(F.col("key").alias("an_key"), F.col("answer").alias(out))
    return back(x.join(said, "an_key", "left").select(*prompts.columns, out))
