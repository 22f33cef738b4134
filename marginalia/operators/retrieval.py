"""Ranking of chunks for queries: filters on documents, exact cosine, per-document top-N, drop-off, top-k.

The order of the steps is part of the semantics: the top of a document is taken before short chunks
and other languages are removed, and drop-off is relative to the best that is left.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import contains_ci, language, word_count
from marginalia.operators.names import cleared
from marginalia.sources.shared import among, few_first, written

#: Queries that a task meets, and chunks, about.
QUERY_BLOCK, PART_CHUNKS = 1 << 14, 1 << 13
#: Chunks of a document from which on it is dealt out in pieces of so many.
SPLIT = 1 << 13
#: Ids of queries that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Scores that a task has in hand at a time.
CELLS = 1 << 19
#: Pairs that a task has in order at a time, of eight bytes each.
PAIRS = 1 << 24
#: Rows and bytes, about, that a task gives out at a time.
OUT_ROWS, OUT_BYTES = 1 << 16, 1 << 24


@dataclass(frozen=True)
class Keep:
    """What a ranking is going to keep, so that a task can leave the rest out; the ranking itself follows on what is left.

    per_document: of each query and document so many of the best. The others hold for what passes that: usable
    and preferred name columns of truth values (unusable chunks go; others than preferred ones go if there is a
    preferred one), share keeps what lies within that share of the best, most so many of the best. unlike names
    a column that must differ from the query's id.
    """

    per_document: int | None = None
    share: float | None = None
    most: int | None = None
    usable: str | None = None
    preferred: str | None = None
    unlike: str | None = None

    @property
    def by_document(self) -> bool:
        return self.per_document is not None


def best(x: np.ndarray, k: int) -> np.ndarray:
    """Which of a row's values are its k greatest, the first of equal ones; none that is minus infinity."""
    if x.shape[1] <= k:
        return x > -np.inf
    edge = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k, None]
    above, at = x > edge, x == edge
    return above | (at & (np.cumsum(at, axis=1) <= k - above.sum(1, keepdims=True)) & (edge > -np.inf))


def selected(sim: np.ndarray, keep: Keep, documents: list[tuple[int, int]], split: np.ndarray, usable: np.ndarray, preferred: np.ndarray) -> np.ndarray:
    """Which of the scores (queries by chunks, in order of document and position) a ranking by keep may need.

    documents are the stretches of one document each. Chunks of a document that other tasks have pieces of
    (split) are kept as far as the document's best go, as their places among these are known only later; but
    once most usable, preferred ones are above, the rest of a piece can be neither among the query's best nor
    push out one that is.
    """
    stays = sim > -np.inf
    if keep.by_document:
        for a, b in documents:
            if b - a > keep.per_document:
                stays[:, a:b] = best(sim[:, a:b], keep.per_document)
    if keep.share is None and keep.most is None:
        return stays
    later = stays & split
    if keep.most is not None and later.any():
        most = max(1, keep.most)
        for a, b in documents:
            if split[a] and b - a > most:
                x = np.where(later[:, a:b] & usable[a:b] & preferred[a:b], sim[:, a:b], -np.inf)
                later[:, a:b] &= sim[:, a:b] >= np.partition(x, b - a - most, axis=1)[:, b - a - most, None]
    open_ = stays & usable & ~split
    first = open_ & preferred
    open_ = np.where(first.any(1, keepdims=True), first, open_)
    x = np.where(open_, sim, -np.inf)
    if keep.share is not None and x.shape[1]:
        top = x.max(1, keepdims=True)
        within = x >= np.where(top > 0, top * (1 - min(0.95, max(0.0, keep.share))) - 1e-9, top)  # the ranking decides on the border
        x = np.where(within, x, -np.inf)
        open_ = open_ & np.where(top > 0, within, best(x, 1))
    if keep.most is not None:
        open_ = best(np.where(open_, sim, -np.inf), max(1, keep.most))
    return open_ | later


def in_order(slices: Iterator[tuple[int, np.ndarray]], width: int, most: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of slices of scores (number of the first query, queries by width chunks; most pairs in all) as queries, chunks and scores, by score.

    Scores are rounded as SQL rounds them, halves away from zero. A pair is one number of score and place, sorted
    where it lies. What is no cosine (not a number, or from vectors so short that their squares vanish) goes ahead as it comes.
    """
    unit, bits = 10**digits, max(1, most - 1).bit_length()
    keys, n = np.empty(most, np.int64), 0
    for at, sim in slices:
        whole = np.copysign(np.floor(np.abs(sim) * unit + 0.5), sim).ravel()
        place = np.arange(at * width, at * width + len(whole))
        if not (fits := np.abs(whole) <= unit).all():
            odd = place[~fits]
            yield odd // width, odd % width, whole[~fits] / unit + 0.0
            whole, place = whole[fits], place[fits]
        keys[n : n + len(whole)] = (whole.astype(np.int64) + unit << bits) | place
        n += len(whole)
    keys = keys[:n]
    keys.sort()
    for at in range(0, n, OUT_ROWS):
        place, whole = keys[at : at + OUT_ROWS] & ((1 << bits) - 1), (keys[at : at + OUT_ROWS] >> bits) - unit
        yield place // width, place % width, whole / unit


def route(requests: DataFrame, hindi: tuple[str, ...]) -> DataFrame:
    """requests with store_lang and fallback: subjects that hold one of the course codes go to the Hindi store, English behind it."""
    hit = F.lit(False)
    for code in hindi:
        hit = hit | F.coalesce(F.upper("subject").contains(code.upper()), F.lit(False))
    return requests.withColumns({"store_lang": F.when(hit, "hi").otherwise("en"), "fallback_lang": F.when(hit, "en")})


def candidates(documents: DataFrame, subject: str | None = None, chapter: str | None = None, block: str | None = None, most: int = 40, order: str = "catalog_pos") -> DataFrame:
    """The first documents, in catalog order, whose derived subject and block fit.

    A chapter that names a block stands in for a missing block. A numbered block fits its number with
    leading zeros, as a word; any other fits as a part of the label. With no filter all documents fit.
    """
    block = block or (chapter if chapter and re.search(r"\bblock\b", chapter, re.IGNORECASE) else None)
    x = documents
    if subject:
        x = x.filter(contains_ci("subject", subject))
    if block:
        number = re.search(r"\bblock\s*(\d+)", block, re.IGNORECASE)
        x = x.filter(F.col("block").rlike(rf"(?iU)\bblock\s*0*{number[1]}\b") if number else contains_ci("block", block))
    return x.orderBy(order).limit(most)


def _dealt(chunks: DataFrame, keep: Keep | None) -> tuple[DataFrame, int]:
    """chunks with p, the part of each, and rt_split, whether its document lies in several; and the number of parts.

    Parts are counted from the rows. A document stays in one part where places within documents matter, but for
    those of many chunks, which are dealt out in pieces.
    """
    spark = chunks.sparkSession
    n = chunks.count()
    parts = max(1, math.ceil(n / min(PART_CHUNKS, max(1024, n // (2 * spark.sparkContext.defaultParallelism)))))
    row = [c for c in ("document_id", "pos", "chunk_id") if c in chunks.columns]
    place = F.xxhash64(*row) if row else F.xxhash64("embedding")
    if keep is None or not keep.by_document:
        return chunks.withColumns({"p": F.pmod(place, F.lit(parts)).cast("int"), "rt_split": F.lit(False)}), parts
    large = chunks.groupBy(F.col("document_id").alias("rt_document")).agg(F.ceil(F.count("*") / SPLIT).alias("rt_pieces")).filter("rt_pieces > 1")
    if n // SPLIT <= 100_000:  # so many documents are that large at most
        large = F.broadcast(large)
    x = chunks.join(large, F.col("document_id").eqNullSafe(F.col("rt_document")), "left")
    piece = F.when(F.col("rt_pieces").isNull(), F.lit(0)).otherwise(F.pmod(place, F.col("rt_pieces")))
    x = x.withColumns({"p": F.pmod(F.xxhash64("document_id", piece), F.lit(parts)).cast("int"), "rt_split": F.col("rt_pieces").isNotNull()})
    return x.drop("rt_document", "rt_pieces"), parts


def score(chunks: DataFrame, queries: DataFrame, keep: Keep | None = None, digits: int | None = None) -> DataFrame:
    """chunks (…, embedding) for each of queries (query_id, query): query_id and sim, the cosine to 12 digits, so that equal vectors tie.

    A stated set of queries against all chunks: without keep a row a pair, with keep those that a ranking by
    it may need, as each task selects from its scores before it gives out a row. Queries are dealt into blocks
    of about QUERY_BLOCK rows and chunks into parts of about PART_CHUNKS; a part meets a block in one task as
    products of matrices. So any number of queries is one plan, and nothing is broadcast that grows with them;
    what a task holds is bounded by a block and a part. Vectors of floats are sent as such and widened there.
    Vectors are compared with those of their length; a zero vector is like nothing. Null vectors and vectors
    with nulls take no part. With digits (and no keep) sim is rounded to so many, and a task gives out pairs in order
    of sim, some PAIRS at a time: equal scores lie together, so that a result as large as all pairs is written in
    about half the bytes. There a block has about PAIRS / PART_CHUNKS queries and meets a part in a task of its own.
    Of queries of one id one counts, that of the largest vector. Own columns called query_id or sim give way; what
    chunks carry is copied to every hit, so join texts to those that stay.
    """
    chunks, back = cleared(chunks, ("query_id", "sim", "p", "b"), ("embedding",), "rt_")
    sound = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = "array<float>" if {queries.schema["query"].dataType.elementType, chunks.schema["embedding"].dataType.elementType} == {T.FloatType()} else "array<double>"
    if digits is not None and (keep is not None or not 0 <= digits <= 9):
        raise ValueError("digits, 0 to 9, are for all pairs")
    block = QUERY_BLOCK if digits is None else min(QUERY_BLOCK, max(1, PAIRS // PART_CHUNKS))
    left = queries.select("query_id", F.col("query").cast(kind).alias("query")).filter(sound("query")).groupBy("query_id").agg(F.max("query").alias("query"))
    blocks = max(1, -(-left.count() // block))
    right = chunks.withColumn("embedding", F.col("embedding").cast(kind)).filter(sound("embedding"))
    right, parts = _dealt(right, keep)
    left = left.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("p", every(parts))
    carried = [c for c in chunks.columns if c != "embedding"]
    order = [(c, "ascending") for c in ("document_id", "pos", "chunk_id") if c in carried]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both sides of a group, whose pairs leave it in pieces: what is held does not grow with their number."""
        sides: tuple[list, list] = ([], [])
        for x in batches:
            for side, rows in enumerate(sides):
                if (some := x.filter(pa.compute.equal(x.column("rt_side"), side))).num_rows:
                    rows.append(some.select(["query_id", "rt_vector"] if side == 0 else [*carried, "rt_split", "rt_vector"]))
        if not all(sides):
            return
        asked, own = (pa.Table.from_batches(rows) for rows in sides)
        if order and own.num_rows:
            own = own.take(pa.compute.sort_indices(own, order, null_placement="at_start"))
        sizes = lambda t, c: t.column(c).combine_chunks().value_lengths().to_numpy()
        matrix = lambda t, c, at, n: t.column(c).take(pa.array(at)).combine_chunks().flatten().to_numpy().reshape(-1, n).astype(float)
        length = lambda m: np.maximum(np.sqrt((m * m).sum(1)), 0) + (m == 0).all(1)
        flag = lambda t, c: t.column(c).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) if c else np.ones(t.num_rows, bool)
        n_asked, n_own = sizes(asked, "rt_vector"), sizes(own, "rt_vector")
        for n in np.intersect1d(n_asked, n_own).tolist():
            i, j = np.flatnonzero(n_asked == n), np.flatnonzero(n_own == n)
            c = matrix(own, "rt_vector", j, n)
            mine = own.take(pa.array(j))
            carry, split = mine.select(carried), flag(mine, "rt_split")
            rows = min(OUT_ROWS, max(1, OUT_BYTES // (1 + carry.nbytes // len(j))))
            usable, preferred = (flag(mine, c) for c in ((keep.usable, keep.preferred) if keep else (None, None)))
            ends = [*np.flatnonzero(_changes(mine.column("document_id").combine_chunks())).tolist(), len(j)] if keep and keep.by_document else []
            c_length, step = length(c), max(1, CELLS // max(1, len(j)))

            def scores(some: np.ndarray) -> np.ndarray:
                q = matrix(asked, "rt_vector", some, n)
                sim = q @ c.T
                sim /= length(q)[:, None] * c_length
                np.round(sim, 12, out=sim)
                sim += 0.0
                return sim

            def given(ids: pa.Array, row: np.ndarray, col: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
                for k in range(0, len(row), rows):
                    r, o = row[k : k + rows], col[k : k + rows]
                    yield from carry.take(pa.array(o)).append_column("query_id", ids.take(pa.array(r))).append_column("sim", pa.array(sim[k : k + rows])).combine_chunks().to_batches()

            if digits is not None:
                many = max(1, PAIRS // len(j))
                for at in range(0, len(i), many):
                    some = i[at : at + many]
                    ids = asked.column("query_id").take(pa.array(some))
                    slices = ((k, scores(some[k : k + step])) for k in range(0, len(some), step))
                    for found in in_order(slices, len(j), len(some) * len(j), digits):
                        yield from given(ids, *found)
                continue
            for at in range(0, len(i), step):
                some = i[at : at + step]
                sim = scores(some)
                ids = asked.column("query_id").take(pa.array(some))
                if keep is None:
                    row, col = np.nonzero(np.ones(sim.shape, bool))
                else:
                    if keep.unlike:
                        sim[np.equal.outer(ids.to_numpy(), mine.column(keep.unlike).to_numpy())] = -np.inf
                    row, col = np.nonzero(selected(sim, keep, list(zip(ends, ends[1:], strict=False)), split, usable, preferred))
                yield from given(ids, row, col, sim[row, col])

    schema = T.StructType([f for f in chunks.schema.fields if f.name != "embedding"] + [queries.schema["query_id"], T.StructField("sim", T.DoubleType())])
    left = left.select("b", "p", F.lit(0).alias("rt_side"), "query_id", F.col("query").alias("rt_vector"))
    right = right.withColumn("b", every(blocks)).withColumn("rt_side", F.lit(1)).withColumnRenamed("embedding", "rt_vector")
    both = left.unionByName(right, allowMissingColumns=True)
    if digits is None:
        return back(both.groupBy("b", "p").applyInArrow(meet, schema))
    both = both.withColumn("rt_group", F.col("b") * parts + F.col("p")).repartitionById(blocks * parts, "rt_group")
    return back(both.groupBy("rt_group").applyInArrow(meet, schema))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column has another value than before; the first is one."""
    if not len(column):
        return np.zeros(0, bool)
    codes = column.dictionary_encode("encode").indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def per_document_top(scored: DataFrame, k: int = 5, tie: str = "pos") -> DataFrame:
    """Of each query and document the best max(10, 10 k)."""
    by = Window.partitionBy("query_id", "document_id").orderBy(F.desc("sim"), tie)
    return scored.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= max(10, 10 * k)).drop("nth")


def length_gate(x: DataFrame, above: int = 5, below: int = 5000) -> DataFrame:
    n = word_count("text")
    return x.withColumn("word_count", n).filter((F.col("word_count") > above) & (F.col("word_count") < below))


def without_glossary(x: DataFrame, title: str = "title") -> DataFrame:
    return x.filter(~F.coalesce(contains_ci(title, "glossary"), F.lit(False)))


def language_filter(x: DataFrame, wanted: str | None, told: Column | None = None, twice: bool = False) -> DataFrame:
    """Hits in the wanted or an unknown language; all of a query's hits if there are none. told is the language, the text's own by default.

    With twice, for hits as many as pairs, x is worked out twice and not shuffled: first for the queries that have
    fitting hits, which are written, then for the hits. So it must give the same rows again.
    """
    if not wanted:
        return x
    x = x.withColumn("fits", (language("text") if told is None else told).isin(wanted, "unknown"))
    if not twice:
        return x.withColumn("any_fits", F.max("fits").over(Window.partitionBy("query_id"))).filter("fits OR NOT any_fits").drop("fits", "any_fits")
    some = written(x.filter("fits").select(F.col("query_id").alias("fitting"), F.lit(True).alias("any_fits")).distinct())
    some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
    return x.join(some, F.col("query_id").eqNullSafe(F.col("fitting")), "left").filter("fits OR any_fits IS NULL").drop("fits", "fitting", "any_fits")


def drop_off(x: DataFrame, most: float = 0.20, tie: tuple[str, ...] = ("document_id", "pos")) -> DataFrame:
    """Hits within a share of the query's best; only the best if it is not positive."""
    share = min(0.95, max(0.0, most))
    by = Window.partitionBy("query_id")
    best = F.max("sim").over(by)
    rank = F.row_number().over(by.orderBy(F.desc("sim"), *tie))
    x = x.withColumns({"best": best, "nth": rank})
    return x.filter(((F.col("best") > 0) & ((F.col("best") - F.col("sim")) / F.col("best") <= share)) | (F.col("nth") == 1)).drop("best", "nth")


def top_k(x: DataFrame, k: int = 5, tie: tuple[str, ...] = ("document_id", "pos")) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("sim"), *tie)
    return x.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(1, k))


def retrieve(
    chunks: DataFrame, queries: DataFrame, documents: DataFrame | None = None, k: int = 5, language_wanted: str | None = None, dropoff: float | None = 0.20, edges: DataFrame | None = None, max_neighbors: int = 6,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Ranked hits: chunks (document_id, pos, chunk_id, title, text, embedding; the first three are a key) for queries (query_id, query).

    texts, if given, holds title and text of chunks by those of the key's columns that it has, and chunks hold none.
    Then words are counted and languages told, for texts of chunks alone, before these join the vectors, and of the texts themselves only
    those of hits are sent, as hits, which are few, are written and go to the texts.
    documents, if given, restricts the search before a vector is read; if it is empty there are no hits.
    With edges, hits get expanded_text and n_neighbors. An empty set of queries gives no rows, and of queries of
    one id one counts. Texts are joined to the hits that stay; own columns of chunks that have the name of one
    of these give way: query_id, sim, rank, word_count, and with edges those named. The work is chunks times
    queries, but a task gives out its best only: some k rows a query, and of documents so large that several
    tasks have pieces of them what stands above the piece's k-th usable chunk, at most max(10, 10 k) a piece.
    """
    from marginalia.operators.graph import expand

    key = ["document_id", "pos", "chunk_id"]
    new = ("query_id", "sim", "rank", "word_count", "expanded_text", "n_neighbors") if edges is not None else ("query_id", "sim", "rank", "word_count")
    chunks, back = cleared(chunks, new, (*key, "title", "text", "embedding"), "rk_")
    pool = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi") if documents is not None else chunks
    about = [word_count("text").alias("word_count"), (language("text") if language_wanted else F.lit("unknown")).alias("rk_told")]
    if texts is None:
        on, slim = key, pool.select(*key, "embedding", *about)
    else:
        on, pool = [c for c in key if c in texts.columns], pool.drop("title", "text")
        slim = pool.join(among(texts, pool.select(*on)).select(*on, *about), on)
    slim = slim.withColumns({"rk_usable": F.expr("word_count > 5 AND word_count < 5000"), "rk_fits": F.col("rk_told").isin(language_wanted or "unknown", "unknown")})
    keep = Keep(per_document=max(10, 10 * k), share=dropoff, most=k, usable="rk_usable", preferred="rk_fits")
    x = per_document_top(score(slim, queries, keep), k).filter("rk_usable")
    x = language_filter(x, language_wanted, F.col("rk_told")) if language_wanted else x
    x = top_k(drop_off(x, dropoff) if dropoff is not None else x, k).drop("rk_told", "rk_usable", "rk_fits")
    bodies = chunks.drop("embedding") if texts is None else texts.select(*on, "title", "text")
    bodies = bodies.withColumnsRenamed({c: f"rk_{c}" for c in on})
    x = few_first(x, bodies, [F.col(c).eqNullSafe(F.col(f"rk_{c}")) for c in on]).drop(*[f"rk_{c}" for c in on])
    return back(expand(x, chunks.drop("embedding"), edges, max_neighbors, texts=texts) if edges is not None else x)


def context(hits: DataFrame, column: str = "text", sep: str = "\n\n") -> DataFrame:
    """query_id, context: a query's hits joined in order of rank; at most k a query."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("t"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), sep).alias("context"))


def retrieve_dual(chunks: DataFrame, topic: DataFrame, theme: DataFrame, **how) -> DataFrame:
    """query_id, topic_chunk, theme_chunk: two searches side by side, in one pass over the chunks."""
    both = topic.select(F.struct("query_id", F.lit("topic").alias("kind")).alias("query_id"), "query").unionByName(
        theme.select(F.struct("query_id", F.lit("theme").alias("kind")).alias("query_id"), "query"))
    x = context(retrieve(chunks, both, **how))
    x = x.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.kind").alias("kind"), "context")
    out = x.groupBy("query_id").pivot("kind", ["topic", "theme"]).agg(F.first("context"))
    return out.select("query_id", F.coalesce("topic", F.lit("")).alias("topic_chunk"), F.coalesce("theme", F.lit("")).alias("theme_chunk"))


def source_meta(hits: DataFrame) -> DataFrame:
    """query_id, meta: of each query's first hit."""
    return hits.filter("rank = 1").select("query_id", F.struct("document_id", "chunk_id", "title", F.col("sim").alias("similarity"), "word_count").alias("meta"))
