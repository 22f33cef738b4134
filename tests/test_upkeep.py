"""Counters by increments, pages by rank, and trees by doubling."""

import random

import pytest

from marginalia.operators import counters, graph, ranks, store

EVENT = "session_id string, seq long, n long, status string"


def log(spark, rows):
    return spark.createDataFrame(rows, EVENT).repartition(2)


def test_counters_follow_the_log(spark, tmp_path):
    r, path = random.Random(3), str(tmp_path / "c")
    rows = [(r.choice(["a", "b", "c", None]), k, r.choice([0, 1, 2, None]), r.choice([None, None, "running", "failed"])) for k in range(90)]
    assert counters.counts(spark, path).count() == 0 and counters.upto(spark, path) == -1
    for k, upto in enumerate((0, 30, 31, 60, 60, 90)):
        touched = counters.refresh(log(spark, rows[:upto]), path)
        assert touched == len({s for s, q, *_ in rows[([0, 0, 30, 31, 60, 60])[k] : upto] if s})
        if k == 3:
            before = sorted(map(tuple, counters.counts(spark, path).collect()))
            counters.compact(spark, path)
            assert sorted(map(tuple, counters.counts(spark, path).collect())) == before and len(counters._pieces(spark, path)) == 1
        want = {}
        for s, q, n, status in rows[:upto]:
            if s:
                old = want.get(s, (0, 0, None))
                want[s] = (q, old[1] + (n or 0), status or old[2])
        assert {x["session_id"]: (x["seq"], x["n"], x["status"]) for x in counters.counts(spark, path).collect()} == want
    sessions = spark.createDataFrame([(s, "pending", 50, 0) for s in "abcd"], "id string, status string, total_requested int, total_generated int")
    assert sorted(map(tuple, store.progress(sessions, counters.rows(spark, path)).collect())) == sorted(map(tuple, store.progress(sessions, log(spark, rows)).collect()))


def test_a_refresh_reads_new_events_only(spark, tmp_path):
    """The bound reaches the scan, and a refresh that was cut off leaves nothing that counts."""
    path, events = str(tmp_path / "c"), str(tmp_path / "events")
    log(spark, [("a", k, 1, None) for k in range(10)]).coalesce(1).write.parquet(events)
    assert counters.refresh(spark.read.parquet(events), path) == 1
    log(spark, [("a", k, 100, None) for k in range(10, 12)]).write.parquet(f"{path}/_cut-off")
    new = spark.read.parquet(events).filter(counters.F.col("seq") > counters.upto(spark, path))
    assert "GreaterThan(seq,9)" in new._jdf.queryExecution().executedPlan().toString()
    assert counters.refresh(spark.read.parquet(events), path) == 0 and counters.counts(spark, path).first()["n"] == 10


@pytest.mark.parametrize("newest_first", [True, False])
def test_pages_by_rank(spark, tmp_path, newest_first):
    path, rows = str(tmp_path / "t"), [(k // 3, k, f"v{k}") for k in range(1000)]
    make = lambda x: spark.createDataFrame(x, "a long, b long, v string").repartition(3)
    ranks.write(make(rows[:700]), path, ("a", "b"), range_rows=90)
    ranks.write(make(rows[:0]), path, ("a", "b"), range_rows=90)
    ranks.write(make(rows[700:]), path, ("a", "b"), range_rows=90)
    want = rows[::-1] if newest_first else rows
    for offset, limit in ((0, 25), (640, 100), (990, 25), (699, 2), (2000, 5), (0, 1000)):
        got = [tuple(r) for r in ranks.page(spark, path, ("a", "b"), offset, limit, newest_first).collect()]
        assert got == want[offset : offset + limit]


def test_a_deep_page_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "t")
    ranks.write(spark.range(2_000_000), path, ("id",), range_rows=100_000)
    wanted, _ = ranks.ranges_of(spark, path, 1_000_000, 25)
    page = ranks.page(spark, path, ("id",), 1_000_000)
    assert len(wanted) <= 2 and [r["id"] for r in page.collect()] == list(range(999_999, 999_974, -1))
    assert "(rank_range#" in page._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


def test_empty_tables(spark, tmp_path):
    ranks.write(spark.range(0), str(tmp_path / "t"), ("id",))
    assert ranks.ranges_of(spark, str(tmp_path / "t"), 0, 25) == ([], 0)


CHUNK = "document_id string, chunk_id string, parent_id string"


def test_roots_of_random_trees(spark):
    r, rows, want = random.Random(5), [], {}
    for d in ("x", "y"):
        up = {}
        for k in range(300):
            up[k] = None if k % 90 == 0 else "gone" if k % 97 == 5 else r.randrange(max(0, k - 3), k)
        rows += [(d, f"{d}{k}", None if p is None else "gone" if p == "gone" else f"{d}{p}") for k, p in up.items()]
        for k in up:
            at, depth = k, 0
            while up.get(at) is not None:
                at, depth = up[at], depth + 1
            want[d, f"{d}{k}"] = ("gone" if at == "gone" else f"{d}{at}", depth)
    got = graph.roots(spark.createDataFrame(rows, CHUNK)).collect()
    assert len(got) == len(want) and {(x["document_id"], x["chunk_id"]): (x["root_id"], x["depth"]) for x in got} == want
    with pytest.raises(ValueError, match="circle"):
        graph.roots(spark.createDataFrame([("d", "a", "c"), ("d", "b", "a"), ("d", "c", "b"), ("d", "x", None)], CHUNK)).count()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda x: rounds.append(1) or plain(x))
    n = 100_000
    chain = spark.range(n).selectExpr("'d' AS document_id", "concat('c', id) AS chunk_id", "if(id = 0, null, concat('c', id - 1)) AS parent_id")
    got = graph.roots(chain)
    assert got.filter("root_id = 'c0' AND concat('c', depth) = chunk_id").count() == n and len(rounds) <= 20
