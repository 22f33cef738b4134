import hashlib
import math
import random

import numpy as np
import pytest

from marginalia.llm import codes, oracles, queries
from tests.llm.sql import same_rows


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """vec_id, code, error, label_error and the codebooks' digest of rows (vec_id, embedding, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [[cut(v, p) for _, v, _, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [cut(v, p) for _, v, _, _ in kept]
            at = [near(x, book)[1] for x in mine]
            for k in set(at):
                own = [x for x, j in zip(mine, at, strict=True) if j == k]
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for i, v, label, _ in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = {label: sum(e for _, _, e, x in out if x == label) for _, _, _, label in out}
    return [(i, c, e, total[label], digest) for i, c, e, label in out]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def awkward(n=300, dims=32, seed=3):
    r = random.Random(seed)
    num = lambda: float(np.float32(r.choice([0.0, -0.0, 0.25, -0.125, r.gauss(0, 0.2)])))
    rows = [(k * 2, [num() for _ in range(dims)], r.choice([1, 2, None])) for k in range(n)]
    rows += [rows[3], rows[3], (6, rows[9][1], 2), (None, rows[0][1], 1), (1, None, 1), (3, [0.5] * (dims - 1) + [None], 1), (5, [float("nan")] + [0.0] * (dims - 1), 2), (7, [float("-inf")] * dims, 2)]
    return rows


def test_query_on_awkward_vectors(spark, tmp_path):
    rows = awkward()
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(4, [0.5] * 16, None), (2, [0.25] * 16, None)]])
def test_query_on_few_vectors(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted(plain(rows))


def test_other_lengths_have_no_code(spark):
    rows = [(k, [float(k)] * 4, 1) for k in range(5)] + [(9, [1.0] * 8, 1), (10, [], 1), (11, [1.0] * 3, 1)]
    df = table(spark, rows).withColumn("code", codes.F.lit("own"))
    got = {r.vec_id: (r.code, r.error) for r in codes.encode(df, codes.train(df, parts=2, entries=4)).collect()}
    assert got[9] == got[10] == got[11] == (None, None) and all(got[k][0] is not None for k in range(5))
    with pytest.raises(ValueError, match="256"):
        codes.train(df, entries=257)


def test_many_groups_are_joined(spark):
    df = spark.createDataFrame([(k, k % 7 if k % 7 else None, k) for k in range(70)], "id long, label int, error long")
    got = [sorted((r.id, r.group_error) for r in codes.with_group_error(df, "label", groups=n).collect()) for n in (3, 100)]
    assert got[0] == got[1] == [(k, sum(x for x in range(70) if x % 7 == k % 7)) for k in range(70)]


def test_bounds_hold_and_few_entries_are_compared():
    rng = np.random.default_rng(5)
    entries, parts = np.floor(rng.normal(0, 40, (64, 4))).astype(np.int64), np.floor(rng.normal(0, 40, (5000, 4))).astype(np.int64)
    entries[40], parts[7] = entries[12], entries[12]
    cells = codes.Cells(entries)
    exact = ((parts[:, None] - entries) ** 2).sum(2)
    lower, upper = cells.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    entry, least, compared = cells.nearest(parts)
    assert (entry == exact.argmin(1)).all() and (least == exact.min(1)).all() and entry[7] == 12
    assert compared < 0.35 * exact.size


def test_more_entries_lose_less(spark):
    rows = awkward(400, 16, 8)[:400]
    df = table(spark, rows)
    lost = [sum(r.error for r in codes.encode(df, codes.train(df, entries=n)).collect()) for n in (4, 64)]
    books = codes.train(df, entries=64)
    back = books.decoded([r.code for r in codes.encode(df, books).orderBy("vec_id").collect()])
    assert lost[1] < lost[0] / 4 and np.abs(back - np.array([v for _, v, _ in rows])).mean() < 0.1


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op11_vector_codes(spark, sf_dir), oracles.oracle_sql()["op11_vector_codes"], sf_dir)
