"""Sessions as keyed state: the stream's last rows against a batch, a plain version, restarts and repeated batches."""

import datetime as dt
import random
import time

import pytest

from marginalia.streaming import machine, sinks

EVENT = "session_id string, seq long, status string, n long, total_requested long, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def event(session, seq, status, n, total, minute):
    return (session, seq, status, n, total, T0 + dt.timedelta(minutes=minute))


def lives(seed=1, n=40):
    """Events of sessions that complete, fail, go on after a failure, or never end; some told twice, some late by some minutes."""
    r = random.Random(seed)
    rows = []
    for s in range(n):
        start, kind = r.randrange(0, 120), r.choice(["completed", "failed", "again", "open", "long"])
        rows.append(event(f"s{s}", 0, "pending", None, 6, start))
        for k in range(1, 4 if kind in ("completed", "again") else 3):
            rows.append(event(f"s{s}", k, "running", 2, None, start + 3 * k))
        if kind == "failed":
            rows.append(event(f"s{s}", 3, "failed", None, None, start + 10))
        if kind == "again":
            rows += [event(f"s{s}", 4, "failed", 0, None, start + 12), event(f"s{s}", 5, "running", None, None, start + 13)]
        if kind == "long":
            rows.append(event(f"s{s}", 3, "running", 2, None, start + 181))
    rows += [rows[r.randrange(len(rows))] for _ in range(20)]
    rows += [(None, 1, "running", 1, 1, T0), ("s0", None, "running", 1, 1, T0)]
    rows.sort(key=lambda e: e[5] + dt.timedelta(minutes=r.randrange(0, 9)))  # late by less than the delay
    return rows


def plain(rows, until, limit=180):
    out = {}
    for s in {e[0] for e in rows if e[0] is not None}:
        mine = {e[1]: e for e in rows if e[0] == s and e[1] is not None}
        start = min(e[5] for e in mine.values())
        end = start + dt.timedelta(minutes=limit)
        mine = {k: e for k, e in mine.items() if e[5] <= end}
        made = sum(e[3] or 0 for e in mine.values())
        asked = max((e[4] for e in mine.values() if e[4] is not None), default=None)
        said = next((mine[k][2] for k in sorted(mine, reverse=True) if mine[k][2]), None) or "pending"
        status, reason = (said, None) if said in machine.TERMINAL or until < end else ("failed", "time limit")
        if asked is not None and made >= asked:
            status, reason = "completed", None
        out[s] = (status, reason, made, asked, max(mine), start)
    return out


def shown(df):
    return {r["session_id"]: (r["status"], r["reason"], r["total_generated"], r["total_requested"], r["last_seq"], r["started"]) for r in df.collect()}


def write(spark, rows, folder, k):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    time.sleep(0.02)


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_batch_against_a_plain_version(spark):
    rows = lives()
    for minute in (60, 200, 500):
        until = T0 + dt.timedelta(minutes=minute)
        assert shown(machine.outcomes(spark.createDataFrame(rows, EVENT).repartition(3), until)) == plain(rows, until)
    assert machine.outcomes(spark.createDataFrame([], EVENT)).count() == 0


def test_stream_against_batch_with_a_restart(spark, tmp_path):
    """Late and repeated events, limits that pass, and a second run from the checkpoint that gets the rest."""
    rows, folder, path = lives(), str(tmp_path / "in"), str(tmp_path / "out")
    last = T0 + dt.timedelta(minutes=390)
    sessions = spark.createDataFrame([("s1",)], "session_id string")
    parts = [rows[k::1][:25] for k in range(0, len(rows), 25)]
    for k, part in enumerate(parts[: len(parts) // 2]):
        write(spark, part, folder, k)
    sinks.follow(stream(spark, folder), sessions, path, str(tmp_path / "checkpoint")).awaitTermination(200)
    half = machine.last_outcomes(sinks.batches(spark, path, machine.OUTCOME)).count()
    for k, part in enumerate(parts[len(parts) // 2 :], len(parts)):
        write(spark, part, folder, k)
    write(spark, [event("end", 0, "pending", 0, 1, 390)], folder, 900)
    sinks.follow(stream(spark, folder), sessions, path, str(tmp_path / "checkpoint")).awaitTermination(200)
    told = sinks.batches(spark, path, machine.OUTCOME)
    got = shown(machine.last_outcomes(told))
    want = plain([*rows, event("end", 0, "pending", 0, 1, 390)], last - dt.timedelta(minutes=10))
    assert got == want and 0 < half < len(want)
    assert {r[1] for r in got.values()} == {None, "time limit"} and {r[0] for r in got.values()} == {"completed", "failed", "pending"}
    assert told.groupBy("session_id", "version").count().filter("count > 1").count() == 0


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    path, x = str(tmp_path / "t"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert sinks.batches(spark, path, "k string, n int").count() == 0
    assert sinks.write_batch(x, 0, path) and not sinks.write_batch(x, 0, path)
    x.write.parquet(f"{path}/_1-cut-off")  # what a driver that was lost halfway leaves
    assert sinks.batches(spark, path, "k string, n int").count() == 2
    assert sinks.write_batch(x, 1, path)
    assert sorted((r["k"], r["n"], r["batch"]) for r in sinks.batches(spark, path, "k string, n int").collect()) == [("a", 1, 0), ("a", 1, 1), ("b", 2, 0), ("b", 2, 1)]


def test_a_query_ends_when_all_sessions_are_over(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [event("a", 0, "pending", None, 1, 0), event("b", 0, "pending", None, 1, 0), event("a", 1, "running", 1, None, 1)], folder, 0)
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    query = sinks.follow(stream(spark, folder), sessions, path, str(tmp_path / "checkpoint"), every="1 second")
    try:
        assert not query.awaitTermination(15)  # b is open
        write(spark, [event("b", 1, "failed", None, None, 2)], folder, 1)
        assert query.awaitTermination(90)
    finally:
        query.stop()
    assert {s: r[0] for s, r in shown(machine.last_outcomes(sinks.batches(spark, path, machine.OUTCOME))).items()} == {"a": "completed", "b": "failed"}


@pytest.mark.parametrize("seed", [2, 3])
def test_arrival_does_not_matter_to_a_batch(spark, seed):
    rows = lives(seed, 15)
    until = T0 + dt.timedelta(minutes=250)
    assert shown(machine.outcomes(spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), EVENT), until)) == plain(rows, until)
