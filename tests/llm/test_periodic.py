import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import oracles, periodic, queries
from tests.llm import fixtures
from tests.llm.sql import same_rows


def plain_runs(w, least=6, times=4):
    """Every period by itself: stretches that agree with the words q on; of one stretch the smallest period."""
    known = {}
    w = np.array([known.setdefault(x, len(known)) for x in w], int)
    found = {}
    for q in range(1, len(w) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], w[q:] == w[:-q], [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text):
    w = text.encode().split() if text else []
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(3, 5))
def test_runs_of_few_words(w, least, times):
    assert periodic.runs(np.array(w, np.int64), least, times) == plain_runs(w, least, times)


def test_runs_in_runs():
    r = random.Random(4)
    for _ in range(300):
        w = []
        while len(w) < 150:
            unit = [r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.randrange(1, 9))]
            w += unit * r.randrange(1, 9) + unit[: r.randrange(len(unit) + 1)]
        w = w * r.choice([1, 1, 5])
        assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_words_outside_repeated_grams_are_passed_over():
    w = np.concatenate([np.arange(1000), np.tile([5000, 5001, 5002], 6), np.arange(2000, 3000)])
    k = periodic.overlap(6, 4)
    assert k == 5 and periodic.segments(periodic.gram_numbers(w, k), k) == [(1000, 1018)]
    assert periodic.runs(w) == [(1000, 18, 3)]
    assert periodic.segments(periodic.gram_numbers(np.arange(5000), k), k) == []


def test_long_texts_take_about_linear_time():
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
        assert periodic.runs(np.tile(np.arange(n // 8), 8)) == [(0, n, n // 8)]
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def test_collapsed_text_and_other_columns(spark):
    df = spark.createDataFrame([(1, "so so so so so so it goes", "own"), (2, None, "own"), (3, "a b a b a b a b c", "own")], "doc_id long, text string, runs string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.find_runs(df).collect()}
    assert got == {1: ("so it goes", [(0, 6, 1)]), 2: ("", []), 3: ("a b c", [(0, 8, 2)])}
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_query_on_awkward_documents(spark, tmp_path):
    rows = fixtures.awkward()
    fixtures.docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    got = queries.op13_periodic_runs(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == sorted((plain_row(*d) for d in docs), key=repr)


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op13_periodic_runs(spark, sf_dir), oracles.oracle_sql()["op13_periodic_runs"], sf_dir)
