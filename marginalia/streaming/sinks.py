"""A table that a stream writes batch by batch, each once, and the end of a stream whose work is done."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from marginalia.sources.shared import exists, take_place


def write_batch(rows: DataFrame, batch: int, path: str) -> bool:
    """Adds a batch's rows to the table at path, unless it holds that batch; whether it did.

    The batch is written under a hidden name and gets its own in one step, so that a reader finds all of it or
    nothing, and one that was cut off halfway is written anew when it comes again. Empty batches are noted too.
    """
    spark = rows.sparkSession
    own = f"{path}/batch={batch}"
    if exists(spark, own):
        return False
    hidden = f"{path}/_{batch}-{uuid.uuid4().hex}"  # Spark's readers pass over names that begin so
    rows.drop("batch").write.parquet(hidden)
    take_place(spark, hidden, own)
    return True


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches, with batch; none before the first."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)


class StopWhen(StreamingQueryListener):
    """Stops a query when a condition holds after one of its batches."""

    def __init__(self, query: StreamingQuery, done: Callable[[], bool]):
        self.query, self.done, self.found = query, done, False

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if str(event.progress.id) == str(self.query.id) and not self.found and self.done():
            self.found = True
            threading.Thread(target=self.query.stop, daemon=True).start()  # a listener must not wait for what it listens to

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def all_over(spark: SparkSession, path: str, schema: str, sessions: DataFrame, terminal: tuple[str, ...], last: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether each of sessions (session_id) has a last row in the table at path, and that with a terminal status."""
    over = last(batches(spark, path, schema)).filter(F.col("status").isin(*terminal)).select("session_id")
    return sessions.join(over, "session_id", "left_anti").isEmpty()


def follow(events: DataFrame, sessions: DataFrame, path: str, checkpoint: str, every: str | None = None, delay: str = "10 minutes", limit_s: int | None = None) -> StreamingQuery:
    """Starts the query that keeps the lives of sessions in the table at path, and ends when all of sessions (session_id) are over.

    events as for machine.lifecycle(). every is the time between batches; without it the query takes what there
    is and ends. Started again with its checkpoint it goes on, and writes no batch twice.
    """
    from marginalia.streaming import machine

    spark = events.sparkSession
    rows = machine.lifecycle(events, delay, limit_s or machine.LIMIT_S)
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, n: write_batch(df, n, path) and None).start()
    if every:
        done = lambda: all_over(spark, path, machine.OUTCOME, sessions, machine.TERMINAL, machine.last_outcomes)
        spark.streams.addListener(StopWhen(query, done))
    return query
