"""Compression of vectors to codes: each part of a vector becomes the index of its codebook's nearest entry.

Components are whole numbers, floor(scale * x), and all sums and distances are exact. The nearest entry is
found as in a VA-file: the coordinates of a codebook's entries are quantised to a few bits, a cell each;
for a part of a vector, two small tables give the least and the greatest squared distance to each cell of
each coordinate, and their sums bound the distance to every entry. Only entries whose lower bound does
not exceed the least upper bound are compared in full.

Codebooks are trained by whole passes over the table: a task adds up its rows by part and entry, and Spark
the tasks' sums, so that what reaches the driver has the size of the codebooks however many rows there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import cleared, row_schema, with_columns, written

#: Components, as whole numbers, stay below this, so that squared distances and their sums fit 64 bits.
LARGEST = 1 << 28
#: Rows that are compared with a codebook at a time, and groups whose sums are broadcast at most.
BLOCK, GROUPS = 4096, 100_000


class Cells:
    """The entries of one codebook with their coordinates quantised to bits bits."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        n, width = entries.shape
        self.entries = entries
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = rank * (1 << bits) // max(1, n)  # cells of as many entries each
        self.low = np.zeros((1 << bits, width), np.int64)
        self.high = np.zeros((1 << bits, width), np.int64)
        for c in range(1 << bits):
            inside = self.cell == c
            if inside.any():  # a cell holds entries of all coordinates or of none, as it is cut by rank
                self.low[c] = np.where(inside, entries, LARGEST).min(0)
                self.high[c] = np.where(inside, entries, -LARGEST).max(0)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part and entry, what the squared distance is at least and at most."""
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            below, above = self.low[:, d] - parts[:, d, None], parts[:, d, None] - self.high[:, d]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, d]]
            upper += (far * far)[:, self.cell[:, d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each part the nearest entry, of equally near ones the first, and its squared distance; and how many distances were taken."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(parts)))]], least, len(row)


@dataclass(frozen=True)
class Codebooks:
    """entries: an array by part, entry and position within the part. Of some kilobytes, whatever was trained on."""

    entries: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def cells(self) -> list[Cells]:
        return [Cells(e) for e in self.entries]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, codes: list[bytes]) -> np.ndarray:
        """What codes stand for, in the vectors' own scale; components are the lower ends of their steps."""
        at = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(self.entries))
        return (self.entries[np.arange(len(self.entries)), at].reshape(len(codes), -1)) / self.scale


def fine(vector: Column) -> Column:
    """Whether a vector has a place: not null, and without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The vectors as rows of whole numbers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components must lie within {LARGEST / scale} of 0")
    return x.astype(np.int64).reshape(-1, dims)


def _codes(cells: list[Cells], rows: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """By part and block of rows: part, rows, the parts themselves, nearest entries, distances."""
    width = rows.shape[1] // len(cells)
    for p, book in enumerate(cells):
        for at in range(0, len(rows), BLOCK):
            some = slice(at, at + BLOCK)
            mine = rows[some, p * width : (p + 1) * width]
            entry, distance, _ = book.nearest(mine)
            yield p, some, mine, entry, distance


def _length(vectors: DataFrame, vector_col: str, parts: int) -> int:
    """The commonest length of vectors that can be cut into parts, of equally common ones the greatest; 0 if there is none."""
    counts = vectors.groupBy(F.size(vector_col).alias("n")).count().filter((F.col("n") % parts == 0) & (F.col("n") > 0))
    first = counts.orderBy(F.desc("count"), F.desc("n")).head()
    return first["n"] if first else 0


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """The codebooks of the vectors' parts.

    A codebook starts as that part of the vectors of the smallest ids (null last, ties by the vector); a round
    gives every part to its nearest entry and moves each entry to floor(sum / count) of its parts, in each
    component; entries without parts stay. Vectors that are null or hold null or non-finite components, and
    those that have not the commonest length that parts divides, take no part. With fewer vectors than entries
    there are fewer entries, with none an empty array. A code is one byte, so entries is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    vectors = vectors.select(id_col, vector_col).filter(fine(F.col(vector_col)))
    dims = _length(vectors, vector_col, parts)
    if not dims:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    vectors, width = vectors.filter(F.size(vector_col) == dims), dims // parts
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(F.col(vector_col).cast("array<double>").alias("x")).collect()
    books = np.array([[[int(np.floor(x * scale)) for x in r.x[p * width : (p + 1) * width]] for r in first] for p in range(parts)], np.int64).reshape(parts, len(first), width)
    schema = "part int, entry int, n bigint, " + ", ".join(f"s{d} bigint" for d in range(width))
    for _ in range(rounds):
        add = _adder(books, scale, vector_col)
        # part and entry number the rows, of which the driver gets one each
        sums = vectors.select(vector_col).mapInArrow(add, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(width)]).collect()
        books = books.copy()
        for r in sums:
            books[r.part, r.entry] = [r[f"s{d}"] // r.n for d in range(width)]
    return Codebooks(books, scale)


def _adder(books: np.ndarray, scale: int, vector_col: str):
    """The function that adds up a task's rows: a row for each part and entry that has any."""
    parts, n, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(e) for e in books]
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in batches:
            for p, _, mine, entry, _ in _codes(cells, _whole(batch.column(vector_col), parts * width, scale)):
                np.add.at(count[p], entry, 1)
                np.add.at(total[p], entry, mine)
        part, entry = np.nonzero(count)
        columns = {"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(count[part, entry])}
        yield pa.RecordBatch.from_pydict(columns | {f"s{d}": pa.array(total[part, entry, d]) for d in range(width)})

    return add


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """vectors without those that are null or hold null or non-finite components, in place of the vector: code and error.

    code has a byte a part, the nearest entry's index (the first of equally near ones); error is the sum of
    the squared distances, in whole numbers of the codebooks' scale. Vectors of another length than the
    codebooks' have neither: both are null. Own columns of these names give way. Rows keep their number
    and their other columns; a row depends on nothing but itself and the codebooks.
    """
    vectors, back = cleared(vectors, ("code", "error"), (vector_col,))
    vectors = vectors.filter(fine(F.col(vector_col)))
    dims, parts, scale = books.dims, len(books.entries), books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = books.cells()
        for batch in batches:
            lengths = batch.column(vector_col).value_lengths().to_numpy(zero_copy_only=False)
            fits = (lengths == dims) & (dims > 0)
            rows = _whole(batch.column(vector_col).filter(pa.array(fits)), dims, scale) if fits.any() else np.zeros((0, max(dims, parts)), np.int64)
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p, some, _, entry, distance in _codes(cells, rows) if len(rows) else ():
                code[some, p] = entry
                error[some] += distance
            at = pa.array(np.cumsum(fits) - 1, mask=~fits)
            yield with_columns(batch, (vector_col,), code=pa.array(map(bytes, code), pa.binary()).take(at), error=pa.array(error).take(at))

    return back(vectors.mapInArrow(run, row_schema(vectors.drop(vector_col), "code binary, error bigint")))


def with_group_error(coded: DataFrame, group_col: str, groups: int = GROUPS) -> DataFrame:
    """coded with group_error: the sum of error over the rows of one group, nulls being one too; rows of null error add nothing.

    Sums are built before the shuffle, a row a task and group. Up to groups groups of 1 kB at most they are broadcast to the rows; beyond,
    the rows are joined to them, and a group of many rows is split by adaptive execution, as it meets a single row.
    """
    coded, back = cleared(coded, ("group_error",), (group_col, "error"), "ge_")
    coded = written(coded)
    sums = written(coded.groupBy(F.col(group_col).alias("ge_group")).agg(F.sum("error").alias("group_error")))
    few = sums.agg(F.count("*").alias("n"), F.max(F.octet_length(F.col("ge_group").cast("string"))).alias("long")).head()
    if few.n <= groups and (few.long or 0) <= 1024:
        sums = F.broadcast(sums)
    return back(coded.join(sums, F.col(group_col).eqNullSafe(F.col("ge_group")), "left").drop("ge_group"))
