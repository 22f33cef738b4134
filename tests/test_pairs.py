"""Scores of all pairs: what tasks hold, carry and shuffle does not grow with the pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import retrieval
from marginalia.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_language_filter_works_twice_instead_of_shuffling_hits(spark):
    rows = [(q, k, t) for q, texts in ((1, ["en", "hi", "unknown"]), (2, ["en", "en"]), (None, ["en", "hi"]), (None, ["unknown"])) for k, t in enumerate(texts)]
    hits = spark.createDataFrame(rows, "query_id int, pos int, told string")
    one, two = (retrieval.language_filter(hits, "hi", F.col("told"), twice=t) for t in (False, True))
    assert "Window" in plan(one) and "Window" not in plan(two)
    assert sorted(map(tuple, two.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
    assert {r["pos"] for r in two.filter("query_id = 2").collect()} == {0, 1}


def test_the_language_query_neither_carries_texts_nor_shuffles_pairs(spark, sf_dir):
    shown = plan(QUERIES["flt6_language_filter"](spark, sf_dir))
    scores = next(line for line in shown.splitlines() if "InArrow" in line)
    assert "Window" not in shown and "text" not in scores.split(", [")[-1]


def test_the_glossary_is_left_out_before_vectors_are_compared(spark, sf_dir):
    shown = plan(QUERIES["flt5_without_glossary"](spark, sf_dir)).splitlines()
    scores = next(k for k, line in enumerate(shown) if "InArrow" in line)
    assert "title" not in shown[scores] and "source" not in shown[scores]
    assert any("glossary" in line for line in shown[scores:]) and not any("glossary" in line for line in shown[:scores])


def test_pairs_leave_a_task_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "OUT_ROWS", 7)
    rows = [(k % 3, k, [1.0, float(k)]) for k in range(40)]
    chunks = spark.createDataFrame(rows, "document_id int, pos long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(5)], "query_id long, query array<double>")
    scores = retrieval.score(chunks, asked)
    assert "CoGroup" not in plan(scores)  # a cogroup's function has to give out all its rows at once
    got = {(r["query_id"], r["pos"]): r["sim"] for r in scores.collect()}
    want = {(q, k): round((q + k) / ((q * q + 1) ** 0.5 * (1 + k * k) ** 0.5), 12) for q in range(5) for k in range(40)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-11 for x in want)


def test_the_flagship_gives_as_many_hits_as_are_within_its_wide_share(spark, sf_dir):
    got = QUERIES["ret1_retrieve"](spark, sf_dir)
    assert got.count() == QUERIES["ret1_retrieve_wide"](spark, sf_dir).count() == 5 * got.select("query_id").distinct().count()


def test_what_a_scoring_task_holds_does_not_grow(spark):
    """Parts and blocks end at a fixed size, and floats are sent as floats; scores are those of doubles all the same."""
    ids = spark.range(4 * 8192 * 8 * 2).select((F.col("id") % 3).alias("document_id"), F.col("id").alias("pos"))
    dealt, parts = retrieval._dealt(ids, None)
    assert dealt.groupBy("p").count().agg(F.max("count")).first()[0] < 10_000 and parts >= 64
    rows = [(k % 3, k, [0.1, float(k), 0.3]) for k in range(40)]
    asked = [(q, [float(q), 0.7, 0.1]) for q in range(5)]
    scores = {}
    for kind in ("float", "double"):
        c = spark.createDataFrame(rows, "document_id int, pos long, embedding array<float>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        y = retrieval.score(c, spark.createDataFrame(asked, "query_id long, query array<float>"))
        assert "as array<double>" not in plan(y) or kind == "double"
        scores[kind] = {(r["query_id"], r["pos"]): r["sim"] for r in y.collect()}
    assert len(scores["float"]) == 200 and scores["float"] == scores["double"]


def test_all_pairs_leave_a_task_in_order_of_score(spark, sf_dir):
    """Else a score takes eight bytes of the result, which is as large as all pairs."""
    got = QUERIES["jn1_cosine_scores"](spark, sf_dir).withColumn("task", F.spark_partition_id()).collect()
    each = {t: [r["sim"] for r in got if r["task"] == t] for t in {r["task"] for r in got}}
    assert len(got) == 2000 and all(x == sorted(x) for x in each.values())


def test_pairs_in_order_take_fewer_bytes(spark, tmp_path):
    """As in large tables, a file's dictionary has room for ids, but not for scores."""
    x = spark.range(2000).select((F.col("id") % 3).alias("document_id"), F.col("id").alias("pos"), F.array(*[F.randn(k) for k in range(16)]).alias("embedding"))
    asked = x.filter("pos % 10 = 0").select(F.col("pos").alias("query_id"), F.col("embedding").alias("query"))
    plain, ordered = retrieval.score(x, asked).withColumn("sim", F.round("sim", 4)), retrieval.score(x, asked, digits=4)
    size, rows = [], []
    for k, y in enumerate((plain, ordered)):
        y.select("query_id", "document_id", "pos", "sim").write.option("parquet.dictionary.page.size", "48000").parquet(f"{tmp_path}/{k}")
        size.append(sum(f.stat().st_size for f in (tmp_path / str(k)).glob("*.parquet")))
        rows.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert rows[1].count() == 400_000 and rows[0].join(rows[1], ["query_id", "document_id", "pos", "sim"]).count() > 399_900  # but for halves, which SQL's way decides
    assert size[1] < 0.7 * size[0]


def test_scores_are_rounded_as_sql_does():
    halves = np.round(np.concatenate([np.arange(-300, 300) + 0.5, np.arange(260_000, 262_000) + 0.5]) / 1e6, 12)
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves.tolist()]).fetchall()]
    row, col, sim = next(retrieval.in_order(iter([(0, halves[:2600].reshape(1, -1))]), 2600, 2600, 6))
    assert sim.tolist() == sorted(want) and [want[c] for c in col] == sim.tolist() and not row.any()
    assert not np.signbit(sim[sim == 0]).any()


def test_what_is_no_cosine_stays_among_the_pairs(spark, monkeypatch):
    sim = np.array([[0.5, np.nan, -1.0], [np.inf, 1.0, 1.4], [0.0, -np.inf, 0.25]])
    found = [np.concatenate(x).tolist() for x in zip(*retrieval.in_order(iter([(0, sim[:2]), (2, sim[2:])]), 3, 9, 6), strict=True)]
    assert sorted(zip(*found[:2])) == [(q, c) for q in range(3) for c in range(3)]
    assert all(np.array_equal(sim[q, c], s, equal_nan=True) for q, c, s in zip(*found))

    monkeypatch.setattr(retrieval, "PAIRS", 50)  # several turns in a task
    rows = [(k % 3, k, v) for k, v in enumerate([[1.0, float(k)] for k in range(40)] + [[float("nan"), 1.0], [0.0, 0.0], [1.0], None, [1.0, None]])]
    chunks = spark.createDataFrame(rows, "document_id int, pos long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(5)] + [(9, [2.0])], "query_id long, query array<double>")
    key = lambda r: (r["query_id"], r["document_id"], r["pos"], repr(r["sim"]))
    want = sorted(map(key, retrieval.score(chunks, asked).withColumn("sim", F.round("sim", 6)).collect()))
    assert sorted(map(key, retrieval.score(chunks, asked, digits=6).collect())) == want and len(want) == 5 * 42 + 1
    with pytest.raises(ValueError):
        retrieval.score(chunks, asked, retrieval.Keep(most=1), digits=6)
