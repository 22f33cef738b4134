import re
from collections import defaultdict

import pytest

from marginalia.llm import mixing, oracles, queries
from tests.llm.fixtures import SCHEMA, docs
from tests.llm.sql import same_rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """By rounds: what is above a cap is shared anew among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def test_targets_and_shares(spark):
    rows = [(k, "w " * (1 + k * 7 % 40), None, f"s{k % 7}" if k % 5 else None, 0, None) for k in range(3000)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["mix_size"] == size(r["text"]) and 0 <= r["mix_copies"] <= 2
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
    want = targets(sizes)
    for r in got:
        assert r["mix_target"] == pytest.approx(want[r["source"]]) and r["mix_source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 40
    again = {(r["doc_id"], r["mix_copies"]) for r in mixing.mix_sources(docs(spark, rows)).collect()}
    assert again == {(r["doc_id"], r["mix_copies"]) for r in got}


def test_awkward_rows(spark):
    got = mixing.mix_sources(docs(spark))
    assert "extra" in got.columns
    for r in got.collect():
        assert r["mix_size"] == size(r["text"])
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = mixing.mix_sources(docs(spark).selectExpr("*", "-1 AS Mix_Size", "'q' AS q_cut"))
    assert {r["q_cut"] for r in clash.collect()} == {"q"} and all(r["mix_size"] == size(r["text"]) for r in clash.collect())
    only = docs(spark, [(1, None, "en", None, 0, None), (2, " ", "en", "a", 0, None)])
    assert {(r["mix_size"], r["mix_target"]) for r in mixing.mix_sources(only).collect()} == {(0, 0.0)}


def test_sizes_of_a_column_and_finer_buckets(spark, monkeypatch):
    rows = [(k, "w " * (1 + k * 7 % 40), None, f"s{k % 3}", 0, None) for k in range(2000)]
    taken = lambda x: {(r["doc_id"], r["mix_size"], r["mix_copies"], r["mix_target"]) for r in x.collect()}
    want = taken(mixing.mix_sources(docs(spark, rows)))
    counted = docs(spark, rows).selectExpr("doc_id", "source", "CASE WHEN doc_id >= 0 THEN 1 + doc_id * 7 % 40 END AS size")
    assert taken(mixing.mix_sources(counted, size_col="size")) == want
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 1 / 64)
    assert taken(mixing.mix_sources(docs(spark, rows))) == want


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op2_mixing(spark, sf_dir), oracles.oracle_sql()["op2_mixing"], sf_dir)
