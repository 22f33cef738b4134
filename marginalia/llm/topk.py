"""Exact top-k by inner product over sorted lists, reading them in order only (no random access).

Candidates are dealt into parts and queries into blocks, both as rows of tables; a task meets one part
with one block, so nothing passes through the driver and no side is broadcast, however many queries
there are. Within a task the candidates are taken in blocks. A block has a list a dimension, sorted by
value; a query reads the lists of its positive weights from the top and the others from the bottom, in
strips. What a strip holds is added to the lower bounds of the candidates it names; the upper bounds
follow from how deep the lists have been read. A candidate whose upper bound is below the k-th best that
the query has, from this block or those before, is out, and later strips pass it over; once few are left
for a query it stops reading, and their scores are resolved.

The tasks' lists merge in a window that keeps k a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, whole_numbers, written

#: Above this bound of a sum of products, floating point would not be exact.
EXACT = float(1 << 53)
#: Candidates that a task meets with a block of queries: at least the first, so that tasks are worth their start, at most the second.
PART_ROWS = (1024, 1 << 18)
#: Queries of a block.
PART_QUERIES = 1 << 16


class Lists:
    """The sorted lists of a block of candidates: one a dimension, read from either end."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        n, dims = rows.shape
        order = np.argsort(-rows, axis=0, kind="stable")
        self.rows, self.ids = rows, ids
        self.down = np.empty((n, dims), np.int32)  # each candidate's place in each list
        np.put_along_axis(self.down, order, np.arange(n, dtype=np.int32)[:, None].repeat(dims, 1), 0)
        self.ranked = np.take_along_axis(rows, order, 0)


def block_top(lists: Lists, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, first_depth: int = 64) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Of each query, the places in the block of its best rows and their scores, k at most; and how many entries of lists were read.

    The values are whole numbers held as floats. A row of the query's own id (own) takes no part; ties go to
    the smaller id. Rows that score less than the query's floor may be left out. Memory is some five
    arrays of 8 bytes a row and query: 84 MB for 4,096 rows and 512 queries.

    A row's upper bound is never below the sum of the lists' frontiers, so until that sum falls below what
    the query has to beat, no row can be out and no bound has to be looked at: queries are grouped by the
    first depth at which it has.
    """
    n, ranked = len(lists.rows), lists.ranked
    depths, at = [], min(n, first_depth)
    while at < n:
        depths.append(at)
        at = min(n, 4 * at if 4 * at < n // 2 else max(n // 2, at + max(1, n // 8)))
    depths.append(n)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    inner = np.array(depths[:-1], int)
    frontier = plus @ ranked[inner].T + minus @ ranked[n - 1 - inner].T
    first = np.where(np.isfinite(floor), (np.column_stack([frontier, np.full(len(queries), -np.inf)]) < floor[:, None]).argmax(1), 0)
    found: list = [None] * len(queries)
    cells = 0
    for start in np.unique(first).tolist():
        some = np.flatnonzero(first == start)
        got, read = _read(lists, queries[some], own[some], floor[some], frontier[some], depths, start, k)
        cells += read
        for q, f in zip(some.tolist(), got, strict=True):
            found[q] = f
    return found, cells


def _read(lists: Lists, queries: np.ndarray, own: np.ndarray, bar: np.ndarray, frontier: np.ndarray, depths: list[int], start: int, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """block_top of queries that look at bounds from depths[start] on."""
    rows, ids, ranked = lists.rows, lists.ids, lists.ranked
    n, dims = rows.shape
    top, low = ranked[0], ranked[-1]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    found: list = [None] * len(queries)
    open_, alive, bar = np.arange(len(queries)), np.arange(n), bar.copy()
    lower = np.repeat((plus @ low + minus @ top)[:, None], n, 1)
    for r in np.flatnonzero(np.isin(ids, own)):
        lower[own == ids[r], r] = -np.inf
    depth = cells = 0
    for step, to in enumerate(depths[start:], start):
        down, x = lists.down[alive], rows[alive]
        up = n - 1 - down
        new_down, new_up = (down >= depth) & (down < to), (up >= depth) & (up < to)
        lower += plus[open_] @ np.where(new_down, x - low, 0).T
        lower += minus[open_] @ np.where(new_up, x - top, 0).T
        cells += len(open_) * dims * (to - depth)
        depth = to
        if len(alive) >= k:
            bar[open_] = np.maximum(bar[open_], np.partition(lower, len(alive) - k, 1)[:, len(alive) - k])
        upper = lower
        if to < n:
            if (frontier[open_, step] >= bar[open_]).all():
                continue
            upper = lower + (plus[open_] * (ranked[to] - low)) @ (down >= to).astype(float).T
            upper += (minus[open_] * (ranked[n - 1 - to] - top)) @ (up >= to).astype(float).T
        may = (upper >= bar[open_][:, None]) & (upper > -np.inf)
        settled = may.sum(1) <= (max(4 * k, (n - to) // 4) if to < n else n)  # to resolve these costs less than to read on
        for j in np.flatnonzero(settled):
            q = open_[j]
            pick = alive[may[j]]
            score = rows[pick] @ queries[q]
            if len(pick) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                pick, score = pick[score >= edge], score[score >= edge]
            by = np.lexsort((ids[pick], -score))[:k]
            found[q] = pick[by], score[by]
        open_ = open_[~settled]
        if not len(open_):
            break
        rest = may[~settled].any(0)
        lower, alive = lower[~settled][:, rest], alive[rest]
    return found, cells


def _plain_top(queries: list, rows: list, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What block_top finds, in whole numbers of any size, for values so large that floating point is not exact."""
    out = []
    for q, o in zip(queries, own, strict=True):
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), int(i), j) for j, (r, i) in enumerate(zip(rows, ids, strict=True)) if i != o)[:k]
        out.append((np.array([j for _, _, j in scored], int), np.array([-s for s, _, _ in scored], object)))
    return out


def _vectors(batch: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and whole-number vectors of the rows that take part."""
    vec = batch.column("vec").combine_chunks()
    sizes = vec.value_lengths()
    keep: dict[int, list[int]] = {}
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.array([x or 0 for x in sizes.to_pylist()]))
    ids = batch.column("id")
    for i, n in enumerate(sizes.to_pylist()):
        if n:
            keep.setdefault(n, []).append(i)
    out = {}
    for n, rows in keep.items():
        at = (ends[rows] - n)[:, None] + np.arange(n)
        x = flat[at]
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[n] = ids.take(pa.array(np.array(rows)[fine])).to_numpy(), np.floor(x[fine] * scale)
    return out


def _met(asked: pa.Table, rows: pa.Table, k: int, scale: int, block: int, query_block: int) -> tuple[list[int], list[int], list[int]]:
    """query ids, ids and scores of each query's best k among the rows."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    candidates = _vectors(rows, scale)
    for n, (own, q) in _vectors(asked, scale).items():
        if n not in candidates:
            continue
        ids, x = candidates[n]
        exact = n * np.abs(x).max() * np.abs(q).max() < EXACT
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        floor = np.full(len(own), -np.inf)
        at, size = 0, min(block, 256)  # the first block is small: what it finds is what the others have to beat
        while at < len(x):
            part, part_ids = x[at : at + size], ids[at : at + size]
            at, size = at + size, min(block, 4 * size)
            lists = Lists(part, part_ids) if exact else None
            for b in range(0, len(own), query_block):
                some = slice(b, b + query_block)
                if exact:
                    found, _ = block_top(lists, q[some], own[some], floor[some], k)
                else:
                    found = _plain_top([[int(v) for v in r] for r in q[some]], [[int(v) for v in r] for r in part], part_ids, own[some], k)
                for j, (pick, score) in enumerate(found, b):
                    i, s = np.concatenate([best[j][0], part_ids[pick]]), np.concatenate([best[j][1], score])
                    by = np.lexsort((i, -s)) if exact else sorted(range(len(i)), key=lambda m: (-s[m], i[m]))  # noqa: B023
                    best[j] = i[by[:k]], s[by[:k]]
                    if exact and len(by) >= k:
                        floor[j] = best[j][1][-1]
        for o, (i, s) in zip(own.tolist(), best, strict=True):
            out[0].extend([o] * len(i))
            out[1].extend(i.tolist())
            out[2].extend(map(int, s))
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096, query_block: int = 512, part_queries: int = PART_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries its k best rows of vectors, exactly.

    Components x count as floor(scale * x); the score is their inner product. Rows with the query's
    id are no candidates of it; ties go to the smaller id. Ids are whole numbers of at most 64 bits; any
    other type is an error at once. Null ids, null or empty vectors and those with null or non-finite
    components take no part; vectors are compared with those of their length. Of rows that repeat in
    vectors each is a candidate; queries that repeat with one id count once, by their largest vector.
    Fewer candidates than k give all of them. Other columns are not read.

    The work is candidates times queries. Each task meets part_queries queries at most with PART_ROWS
    candidates at most, by place and not by id, so no id makes a task large; it works through them in
    blocks of block rows and query_block queries.
    """
    whole_numbers(vectors, id_col)
    whole_numbers(queries, id_col)
    spark = vectors.sparkSession
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vec") > 0)
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)
    candidates = written(own(vectors).withColumn("at", F.monotonically_increasing_id()))
    asked = checkpointed(own(queries).groupBy("id").agg(F.max("vec").alias("vec")))
    n_rows, blocks = candidates.count(), max(1, math.ceil(asked.count() / part_queries))
    low, high = PART_ROWS
    parts = max(1, math.ceil(n_rows / min(high, max(low, n_rows // (4 * spark.sparkContext.defaultParallelism)))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("p", each(parts))
    right = candidates.withColumn("p", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int")).drop("at").withColumn("b", each(blocks))

    def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
        query_id, vec_id, score = _met(q, rows, k, scale, block, query_block) if q.num_rows and rows.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64())})

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
