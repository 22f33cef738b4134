"""The life of a generation session as keyed state: pending, running, completed or failed, with a time limit.

A session's state follows from the set of its events alone, not from their order or how often they came:
of events of one number one counts, those after the limit do not, the status is that of the highest
number, enough questions make it completed whatever that says, and a session that has not ended when the
watermark passes its limit has failed. So the stream's last rows are those of a batch over the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statuses after which nothing is waited for.
TERMINAL = ("completed", "failed")
#: How long a session may take, as the tasks of the store are limited; a fixed value.
LIMIT_S = 10_800
OUTCOME = "session_id string, status string, reason string, total_generated bigint, total_requested bigint, last_seq bigint, started timestamp, version bigint"


def outcomes(events: DataFrame, until=None, limit_s: int = LIMIT_S) -> DataFrame:
    """session_id, status, reason, total_generated, total_requested, last_seq, started of all events, as a batch.

    events: session_id, seq, status (null: only a count), n (questions made, null: none), total_requested (null but
    where it is told), ts. until is the time up to which events are in, the latest event's by default. Rows of null
    session_id, seq or ts do not count.
    """
    x = events.filter("session_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL")
    until = F.lit(until).cast("timestamp") if until is not None else F.lit(x.agg(F.max("ts")).first()[0]).cast("timestamp")
    least = F.min(F.struct("ts", "status", "n", "total_requested"))
    x = x.groupBy("session_id", "seq").agg(least.alias("e")).select("session_id", "seq", "e.*")
    started = x.groupBy("session_id").agg(F.min("ts").alias("started"))
    end = F.col("started") + F.make_dt_interval(secs=F.lit(limit_s))
    x = x.join(started, "session_id").filter(F.col("ts") <= end)
    x = x.groupBy("session_id", "started").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("said"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("total_generated"),
        F.max("total_requested").cast("long").alias("total_requested"), F.max("seq").cast("long").alias("last_seq"))
    enough = F.coalesce(F.col("total_generated") >= F.col("total_requested"), F.lit(False))
    late = (until >= end) & ~F.coalesce(F.col("said").isin(*TERMINAL), F.lit(False))
    status = F.when(enough, "completed").when(late, "failed").otherwise(F.coalesce("said", F.lit("pending")))
    reason = F.when(~enough & late, "time limit")
    return x.select("session_id", status.alias("status"), reason.alias("reason"), "total_generated", "total_requested", "last_seq", "started")


class Session(StatefulProcessor):
    """Keeps a session's events by number until its limit has passed; then its last word is given out and the state goes."""

    def __init__(self, limit_s: int = LIMIT_S):
        self.limit_ms = limit_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq bigint", "ts bigint, status string, n bigint, total_requested bigint")
        self.said = handle.getValueState("said", "started bigint, version bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        changed = False
        for r in rows:
            new = (r.ts_ms, r.status, r.n, r.total_requested)
            old = self.events.getValue((r.seq,)) if self.events.containsKey((r.seq,)) else None
            if old is None or _order(new) < _order(tuple(old)):
                self.events.updateValue((r.seq,), new)
                changed = True
        if changed:
            yield self._told(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield self._told(key, True)
        self.events.clear()
        self.said.clear()

    def _told(self, key: tuple, over: bool) -> Row:
        events = {k[0]: tuple(v) for k, v in self.events.iterator()}
        started, version = min(e[0] for e in events.values()), 1
        if self.said.exists():
            before, version = self.said.get()[0], self.said.get()[1] + 1
            if before != started and not over:
                self.handle.deleteTimer(before + self.limit_ms)
        if not over:
            self.handle.registerTimer(started + self.limit_ms)
        self.said.update((started, version))
        within = {k: e for k, e in events.items() if e[0] <= started + self.limit_ms}
        asked = max((e[3] for e in within.values() if e[3] is not None), default=None)
        made = sum(e[2] or 0 for e in within.values())
        said = next((within[k][1] for k in sorted(within, reverse=True) if within[k][1] is not None), None)
        status, reason = said or "pending", None
        if asked is not None and made >= asked:
            status = "completed"
        elif over and said not in TERMINAL:
            status, reason = "failed", "time limit"
        return Row(session_id=key[0], status=status, reason=reason, total_generated=made, total_requested=asked, last_seq=max(within), started_ms=started, version=version)


def _order(event: tuple) -> tuple:
    """Of events of one number the first in this order counts, nulls first, as in a batch."""
    return tuple((x is not None, x if x is not None else 0) for x in event)


def lifecycle(events: DataFrame, delay: str = "10 minutes", limit_s: int = LIMIT_S) -> DataFrame:
    """OUTCOME rows of a stream of events as for outcomes(), for update mode: a row of a session whenever it changes, version counting them.

    A session's last row is that of highest version. State is kept by session until the watermark, delay behind
    the latest event, passes the session's limit; events that are older than the watermark do not count.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # maps and timers need it
    x = events.filter("session_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    x = x.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "status", F.col("n").cast("long").alias("n"), F.col("total_requested").cast("long").alias("total_requested"), "ts", F.unix_millis("ts").alias("ts_ms"))
    ddl = OUTCOME.replace("started timestamp", "started_ms bigint")
    out = x.groupBy("session_id").transformWithState(statefulProcessor=Session(limit_s), outputStructType=ddl, outputMode="Update", timeMode="EventTime")
    return out.withColumn("started", F.timestamp_millis("started_ms")).select(*[c.split(" ")[0] for c in OUTCOME.split(", ")])


def last_outcomes(rows: DataFrame) -> DataFrame:
    """Of a table of OUTCOME rows the last of each session; combined before the shuffle."""
    names = [c for c in rows.columns if c not in ("session_id", "version", "batch")]
    last = rows.groupBy("session_id").agg(F.max(F.struct("version", *names)).alias("o"))
    return last.select("session_id", *[f"o.{c}" for c in names])
