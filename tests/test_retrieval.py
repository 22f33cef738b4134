"""Ranking with selection in the tasks, against brute force."""

import random

import numpy as np
import pytest

from marginalia.operators import retrieval
from marginalia.queries import QUERIES
from marginalia.sources import shared

SCHEMA = "document_id int, pos long, chunk_id string, title string, text string, embedding array<double>"


def corpus(n=400, seed=1):
    """A third of the chunks in one document, vectors that tie, chunks that are too short, a few in Hindi, null vectors and ids."""
    r = random.Random(seed)
    vectors = [[r.choice([-1.0, 0.0, 0.5, r.gauss(0, 1)]) for _ in range(5)] for _ in range(60)]
    rows = []
    for k in range(n):
        document = 7 if k % 3 == 0 else r.choice([1, 2, 3, 4, None])
        words = " ".join((["नमस्ते"] if k % 40 == 1 else ["word"]) * r.randrange(3, 12))
        rows.append((document, k, f"c{k}", "t", words, None if k % 50 == 49 else [0.0] * 5 if k % 50 == 48 else vectors[r.randrange(60)]))
    return rows


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return round(float(a @ b / n), 12) + 0.0 if n else 0.0


def null_first(document):
    return document is not None, document or 0


def brute(rows, asked, k, share, wanted):
    out = {}
    for q, v in asked:
        scored = [(cosine(v, r[5]), r) for r in rows if r[5] is not None]
        scored.sort(key=lambda x: (-x[0], null_first(x[1][0]), x[1][1]))
        seen, hits = {}, []
        for s, r in scored:
            seen[r[0]] = seen.get(r[0], 0) + 1
            if seen[r[0]] <= max(10, 10 * k) and 5 < len(r[4].split()) < 5000:
                hits.append((s, r))
        if wanted:
            fit = [h for h in hits if ("hi" if h[1][4][0] == "न" else "en") == wanted]
            hits = fit or hits
        if share is not None and hits:
            top = hits[0][0]
            hits = [h for h in hits if top > 0 and (top - h[0]) / top <= share] or hits[:1]
        out |= {(q, n + 1): (h[1][2], h[0]) for n, h in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize(("k", "share", "wanted"), [(5, 0.2, None), (3, None, None), (2, 0.95, "hi"), (4, 0.5, "en"), (1, 0.0, None)])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, k, share, wanted, small):
    if small:  # many blocks, parts and pieces of documents
        for name, value in {"QUERY_BLOCK": 3, "PART_CHUNKS": 40, "SPLIT": 25, "CELLS": 64}.items():
            monkeypatch.setattr(retrieval, name, value)
    rows = corpus()
    asked = [(q, [random.Random(q).gauss(0, 1) for _ in range(5)]) for q in range(12)] + [(90, [0.0] * 5), (91, [-1.0, 0.0, 0.0, 0.0, 0.0])]
    got = retrieval.retrieve(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(asked, "query_id long, query array<double>"), k=k, dropoff=share, language_wanted=wanted)
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["sim"]) for r in got.collect()} == brute(rows, asked, k, share, wanted)


def test_a_task_gives_out_few_rows(spark):
    rows = [(k % 100, k, f"c{k}", "t", "a b c d e f g", [float(k % 17), 1.0, float(k % 5)]) for k in range(6000)]
    chunks, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(q, [1.0, float(q), 0.0]) for q in range(50)], "query_id long, query array<double>")
    slim = chunks.select("document_id", "pos", "embedding")
    _, parts = retrieval._dealt(slim, retrieval.Keep(most=5))
    assert retrieval.score(slim, asked).count() == 50 * 6000
    assert retrieval.score(slim, asked, retrieval.Keep(most=5)).count() <= 50 * 5 * parts
    assert retrieval.score(slim, asked, retrieval.Keep(per_document=10)).count() == 50 * 100 * 10
    assert retrieval.score(slim, asked, retrieval.Keep(per_document=10, share=0.2, most=5)).count() <= 50 * 5 * parts


def test_clashing_columns_repeated_queries_and_null_keys(spark):
    rows = [(1, 1, "a", "t", "one two three four five six", [1.0, 0.0], "own"), (None, None, None, None, "one two three four five six", [0.9, 0.1], "own")]
    names = [n for n in ("sim", "rank", "query_id", "word_count", "rt_split", "rk_told", "p")]
    for name in names:
        chunks = spark.createDataFrame(rows, f"{SCHEMA}, {name} string")
        asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 0.0])], "query_id long, query array<double>")
        got = retrieval.retrieve(chunks, asked, dropoff=None).orderBy("rank").collect()
        assert [(r["rank"], r["chunk_id"]) for r in got] == [(1, "a"), (2, None)]
        assert got[0].asDict().get(name) == ("own" if name[:2] in ("rt", "rk") or name == "p" else got[0][name])
    assert retrieval.retrieve(chunks.limit(0), asked).count() == retrieval.retrieve(chunks, asked.limit(0)).count() == 0


def test_best_takes_the_first_of_equals():
    x = np.array([[1.0, 3.0, 3.0, 3.0, 2.0], [-np.inf, -np.inf, 1.0, -np.inf, -np.inf], [5.0, 5.0, 5.0, 5.0, 5.0]])
    assert retrieval.best(x, 2).tolist() == [[False, True, True, False, False], [False, False, True, False, False], [True, True, False, False, False]]


@pytest.mark.parametrize(("k", "share", "wanted"), [(5, 0.2, None), (2, 0.95, "hi"), (3, None, None)])
def test_texts_apart_give_the_same(spark, monkeypatch, k, share, wanted):
    for name, value in {"QUERY_BLOCK": 3, "PART_CHUNKS": 40, "SPLIT": 25}.items():
        monkeypatch.setattr(retrieval, name, value)
    chunks = spark.createDataFrame([r for r in corpus() if r[0] is not None], SCHEMA)
    asked = spark.createDataFrame([(q, [random.Random(q).gauss(0, 1) for _ in range(5)]) for q in range(12)], "query_id long, query array<double>")
    edges = spark.createDataFrame([(r[0], r[2], f"c{r[1] + d}", "r", d) for r in corpus() if r[0] is not None for d in (2, 3, 6, 9)], "document_id int, src string, dst string, relation string, ord int")
    how = {"k": k, "dropoff": share, "language_wanted": wanted, "edges": edges, "max_neighbors": 2}
    one = retrieval.retrieve(chunks, asked, **how)
    for few in (250_000, 0):  # hits go to the texts, or both are shuffled
        monkeypatch.setattr(shared, "FEW", few)
        monkeypatch.setattr(shared, "KEYS", few)
        two = retrieval.retrieve(chunks.drop("title", "text"), asked, **how, texts=chunks.select("pos", "title", "text"))
        assert set(map(tuple, two.select(one.columns).collect())) == set(map(tuple, one.collect()))
    assert one.filter("n_neighbors > 0").count() > 0


def test_pieces_of_a_document_give_out_what_can_count(spark, monkeypatch):
    """Of a piece what stands above its fifth usable chunk, not 50 rows; the ranking is brute force's, short chunks on top or not."""
    for name, value in {"PART_CHUNKS": 200, "SPLIT": 200}.items():
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(3)
    rows = [(1, n, f"c{n}", "t", " ".join(["word"] * (3 if n % 5 == 0 or 300 < n < 360 else 7)), [r.gauss(3, 1) if 300 < n < 360 else r.gauss(0, 1) for _ in range(4)]) for n in range(2000)]
    asked = [(q, [random.Random(q).gauss(0.5, 1) for _ in range(4)]) for q in range(20)]
    chunks, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "query_id long, query array<double>")
    slim = chunks.selectExpr("document_id", "pos", "embedding", "size(split(text, ' ')) > 5 AS long")
    _, parts = retrieval._dealt(slim, retrieval.Keep(per_document=50))
    given = retrieval.score(slim, queries, retrieval.Keep(per_document=50, most=5, usable="long")).count()
    assert parts > 4 and given < 20 * 10 * 25
    got = retrieval.retrieve(chunks, queries, k=5, dropoff=None).collect()
    assert {(x["query_id"], x["rank"]): (x["chunk_id"], x["sim"]) for x in got} == brute(rows, asked, 5, None, None)


@pytest.mark.parametrize("name", ["ret1_retrieve_expanded", "ret1_retrieve_wide", "ret1_retrieve", "agg11_context", "prj10_source_meta", "ret4_retrieve_dual", "flt3_no_match"])
def test_no_text_is_shuffled_but_those_of_hits(spark, sf_dir, name):
    """Ranked hits are written and go to the texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("InArrow" in line for line in shown)  # ranked hits were written before
    assert name == "flt3_no_match" or any("leftHint=(strategy=broadcast)" in line for line in shown)


def test_only_texts_of_chunks_are_looked_at(spark, sf_dir, monkeypatch):
    """Texts of no chunk are left out by their keys before words are counted."""
    plans, score = [], retrieval.score
    monkeypatch.setattr(retrieval, "score", lambda c, *a: plans.append(c._jdf.queryExecution().optimizedPlan().toString().splitlines()) or score(c, *a))
    QUERIES["ret1_retrieve"](spark, sf_dir)
    (shown,) = plans
    at = {w: next(k for k, line in enumerate(shown) if w in line) for w in ("regexp_extract_all", "LeftSemi")}  # counting words is that
    assert at["regexp_extract_all"] < at["LeftSemi"]
