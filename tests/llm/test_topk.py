import math
import random

import numpy as np
import pytest

from marginalia.llm import oracles, queries, topk
from tests.llm.sql import same_rows


def brute(rows, asked, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i in asked:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5, r.gauss(0, 1)]) for _ in range(6)]) for k in range(900)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(2000, None), (2100, []), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] * 6), (None, [1.0] * 6), (2500, [0.0] * 6), (2600, [1.0, 2.0])]
    rows += [(3000 + k, list(rows[0][1])) for k in range(30)]
    df = vectors(spark, rows).repartition(3)
    monkeypatch.setattr(topk, "PART_ROWS", (100, 300))
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), block=128, query_block=4, part_queries=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0})


def test_few_huge_and_none(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 0.0])]
    df = vectors(spark, rows)
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id = 0")).collect())) == brute(rows, {0})
    rows = [(k, [2e6 + k, -1e6]) for k in range(20)]
    df = vectors(spark, rows)
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id = 0")).collect())) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], {0})
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_ids_of_other_types_are_an_error(spark):
    df = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>")
    with pytest.raises(TypeError, match="vec_id"):
        topk.top_k(df, df)


def test_nothing_passes_through_the_driver(spark):
    """One plan, however many blocks of queries there are, and no broadcast."""
    df = vectors(spark, [(k, [float(k), 1.0]) for k in range(50)])
    plans = [topk.top_k(df, df, part_queries=n)._jdf.queryExecution().toString() for n in (100, 5)]
    assert all(p.count("FlatMapCoGroupsInArrow") == plans[0].count("FlatMapCoGroupsInArrow") and "Broadcast" not in p for p in plans)


def test_stops_before_the_lists_end():
    """A clear winner is found at the first depth; entries that were read are counted."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (4000, 3)).astype(float)
    rows[:12] = 5000 - np.arange(12)[:, None]
    found, cells = topk.block_top(topk.Lists(rows, np.arange(4000)), np.ones((1, 3)), np.array([-1]), np.array([-np.inf]), 10)
    assert found[0][0].tolist() == list(range(10)) and cells == 3 * 64


def test_a_floor_saves_reading():
    """In vectors without structure, what blocks before have found ends the reading after some six tenths."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40_000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))
    q, scores = x[:50], x[:50] @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    floor = np.sort(scores, 1)[:, -10]
    lists = topk.Lists(x[:4000], np.arange(4000))
    bare, with_floor = (topk.block_top(lists, q, np.arange(50), f, 10) for f in (np.full(50, -np.inf), floor))
    assert with_floor[1] <= 0.75 * 50 * 64 * 4000 and with_floor[1] < bare[1] <= 50 * 64 * 4000
    for j, (pick, score) in enumerate(with_floor[0]):
        want = np.flatnonzero(scores[j, :4000] >= floor[j])
        assert set(want) <= set(pick.tolist()) and (score == scores[j, pick]).all()
    for j, (pick, _) in enumerate(bare[0]):
        assert set(pick.tolist()) == set(np.lexsort((np.arange(4000), -scores[j, :4000]))[:10].tolist())


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op7_exact_top_k(spark, sf_dir), oracles.oracle_sql()["op7_exact_top_k"], sf_dir)
