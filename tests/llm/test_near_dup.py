import itertools
import random

import numpy as np
import pytest

from marginalia.llm import near_dup, oracles, queries
from marginalia.llm.graph import components
from tests.llm.fixtures import SCHEMA, awkward, docs
from tests.llm.sql import same_rows


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, texts = [0] * len(rows), [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            if a != b:
                texts[i].add(frozenset(b))
                texts[j].add(frozenset(a))
            root[find(i)] = find(j)
    big = 1 << 62
    least = lambda ids: min((x if x is not None else big for x in ids), default=big)
    out = []
    for i, r in enumerate(rows):
        same = [j for j in range(len(rows)) if j == i or (sets[i] and sets[j] == sets[i])]
        group = [j for j in range(len(rows)) if find(j) == find(i)]
        none = lambda x: None if x == big else x
        out.append((r[0], none(least(rows[j][0] for j in group)), none(least(rows[j][0] for j in same)), len(same), links[i], len(texts[i])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small,block", [(16, 2048), (2, 3)])
def test_against_all_pairs(spark, small, block):
    r = random.Random(5)
    rows = awkward()
    base = [f"t{k}" for k in range(90)]
    for k in range(14):  # a group of near copies, larger than a small bucket and than a block
        own = list(base)
        own[r.randrange(90)] = f"new{k}"
        rows.append((1000 + k, " ".join(own), "en", "s1", 0, None))
    got = near_dup.near_duplicates(docs(spark, rows), small=small, block=block)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("small,block", [(4, 16)])
def test_a_chain_goes_bucket_by_bucket(spark, monkeypatch, small, block):
    """Texts that each share most with their neighbours in a long row: one region, of which few pairs are candidates."""
    seen = []
    real = near_dup.region_kinds
    monkeypatch.setattr(near_dup, "region_kinds", lambda *x: seen.append(real(*x)) or seen[-1])
    w = [f"v{k}" for k in range(500)]
    rows = [(k, " ".join(w[2 * k : 2 * k + 60]), "en", "s1", 0, None) for k in range(120)]
    got = near_dup.near_duplicates(docs(spark, rows), small=small, block=block)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)
    kinds = seen[0].collect()
    large = max((sum(r["region"] == g for r in kinds), g) for g in {r["region"] for r in kinds})
    assert large[0] >= 40 and not any(r["whole"] for r in kinds if r["region"] == large[1])


def test_recall_on_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85: at least 0.99 of them are found."""
    r, rows = random.Random(8), []
    for k in range(300):
        base = [f"d{k}w{i}" for i in range(110)]
        other = list(base)
        at = r.randrange(10, 90)
        other[at : at + 5] = [f"x{k}{i}" for i in range(5)]
        rows += [(2 * k, " ".join(base), "en", "s", 0, None), (2 * k + 1, " ".join(other), "en", "s", 0, None)]
    a, b = grams(rows[0][1]), grams(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) <= 0.85
    assert near_dup.near_duplicates(docs(spark, rows)).filter("n_links = 1").count() >= 0.99 * len(rows)


def test_ids_of_other_types_are_an_error(spark):
    with pytest.raises(TypeError, match="doc_id"):
        near_dup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reach_recall():
    bands, rows = near_dup.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_compare_in_chunks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 200)).astype(np.uint64) for _ in range(30)]
    got = near_dup.compare(sets, sets, 0.5, columns=37)
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5 for b in sets] for a in sets]
    assert got.tolist() == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["cc_node"]: r["cc_root"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op1_ngram_jaccard_join(spark, sf_dir), oracles.oracle_sql()["op1_ngram_jaccard_join"], sf_dir)
