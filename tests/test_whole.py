"""Queries and operators on fixtures beyond what the small tables hold."""

import hashlib

import numpy as np
import pytest

from marginalia.operators import citations, graph, ordering, retrieval
from marginalia.queries import QUERIES
from marginalia.sources import writers


def test_transcripts_of_long_chats(spark, tmp_path):
    """Turns from 1000 on are in the transcript, and a chat with no others is there."""
    turns = {1: range(2500), 2: range(1000, 1003), 3: range(2)}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"text {k}") for c, ks in turns.items() for k in ks]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: hashlib.md5("\n".join(f"{'User' if k % 2 == 0 else 'Assistant'}: text {k}" for k in ks).encode()).hexdigest() for c, ks in turns.items()}
    assert {r["conv_id"]: r["h"] for r in QUERIES["txt23_transcripts"](spark, str(tmp_path)).collect()} == want
    assert {r["conv_id"] for r in QUERIES["ret6_explore_chat"](spark, str(tmp_path)).collect()} == set(turns)


def test_ancestors_to_the_root(spark, tmp_path):
    """A document of so many lines that the last have more than six ancestors."""
    n = 3500
    spark.createDataFrame([(1, "\n".join(map(str, range(n))))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parent = {p: None if p % 7 == 5 else (p - 1) // 3 for p in range(1, n)}  # None: a parent that is not there
    want = set()
    for p in range(1, n):
        at, far = p, 0
        while at in parent:
            at, far = parent[at], far + 1
            want.add((f"d1_{p}", "gone" if at is None else f"d1_{at}", far))
    assert max(far for _, _, far in want) > 6
    got = [(r["chunk_id"], r["ancestor_id"], r["distance"]) for r in QUERIES["graph_ancestors"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_ancestors_in_a_circle(spark):
    rows = [("d", "a", "c"), ("d", "b", "a"), ("d", "c", "b"), ("d", "x", "a")]
    with pytest.raises(ValueError, match="its own ancestor"):
        graph.ancestors(spark.createDataFrame(rows, "document_id string, chunk_id string, parent_id string"))


def test_retrieval_of_many_queries(spark, monkeypatch):
    """Against brute force, with more queries than one block takes."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    v, n_words = rng.normal(size=(300, 8)), rng.integers(3, 12, 300)
    chunks = spark.createDataFrame([(k % 4, k, f"c{k}", "t", " ".join(["w"] * int(n_words[k])), v[k].tolist()) for k in range(300)], "document_id int, pos long, chunk_id string, title string, text string, embedding array<double>")
    asked = chunks.filter("pos % 6 = 0").selectExpr("pos AS query_id", "embedding AS query")
    got = {(r["query_id"], r["rank"]): (r["pos"], r["text"], r["title"]) for r in retrieval.retrieve(chunks, asked, k=1, dropoff=0.95).collect()}
    unit, want = v / np.linalg.norm(v, axis=1, keepdims=True), {}
    for q in range(0, 300, 6):
        sim = unit @ unit[q]
        hits = [p for d in range(4) for p in sorted(range(d, 300, 4), key=lambda p: -sim[p])[:10] if n_words[p] > 5]
        best = max(sim[p] for p in hits)
        first = max(hits, key=lambda p: sim[p])
        assert best > 0
        want[q, 1] = (first, " ".join(["w"] * int(n_words[first])), "t")
    assert got == want


def test_citations_after_the_first_200_characters(spark, tmp_path):
    body = "word " * 100 + "end (Canto V, 9) and (33) on"
    spark.createDataFrame([(3, body, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    one = lambda name: QUERIES[name](spark, str(tmp_path)).first()["h"]
    assert one("txt8_strip_citations") == md5("To be or not " + "word " * 100 + "end and on")
    assert one("txt9_locator") == md5("Canto V, 9")
    assert one("txt19_strip_thinking") == md5("s")
    assert QUERIES["txt21_wrap_label"](spark, str(tmp_path)).first()["label"] == "word word word word\nword word word word..."


def test_every_chunk_node_question_and_event(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    run = lambda name: QUERIES[name](spark, sf_dir)
    lines = read("documents").selectExpr("sum(size(split(text, '\\n')))").first()[0]
    assert run("jn4_graph_expand").count() == lines
    assert run("snk12_print_pages").count() == read("documents").count()
    assert run("top11_newest_first").filter("place = 1").count() == read("events").select("user_id").distinct().count()
    assert run("set5_isolated_nodes").filter("substring_index(id, ':', -1) % 2 = 1").count() > 0


def test_numbers_do_not_depend_on_the_ranges(spark):
    rows = [(k * 7919 % 5003, f"k{k % 50}") for k in range(5000)] + [(None, "x"), (3, None)]
    x = spark.createDataFrame(rows, "a long, b string").repartition(5)
    want = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or ""), (r[0] is not None, r[0] or 0)))
    for size in (10**6, 400, 37):
        got = {(r["a"], r["b"]): r["n"] for r in ordering.numbered(x, ("b", "a"), "n", rows_a_task=size).collect()}
        assert got == {r: k + 1 for k, r in enumerate(want)}
    assert ordering.numbered(x.limit(0), ("b", "a"), "n").count() == 0


def test_null_keys_are_appended_once(spark, tmp_path):
    x = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "k int, v string")
    for _ in range(2):
        writers.append_new(x, f"{tmp_path}/t", ("k", "v"))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
