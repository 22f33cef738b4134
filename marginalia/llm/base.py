"""What the training-data operators share: the word rule, checkpoints, internal names, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.names import cleared  # noqa: F401
from marginalia.sources.shared import remove, scratch, shared_dir, written  # noqa: F401

#: A word is a longest run of characters other than these (space, tab to carriage return).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the rows that a Python worker is sent together, unless one row has more. By default Spark sends 10,000 rows, which may be tens of MB of text in the JVM and in the worker.
ARROW_BYTES = 8 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; what is there goes when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    folder = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())  # Spark's own for this application
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.checkpoint()


def modest_batches(spark: SparkSession) -> None:
    """From now on the session sends its Python workers batches of at most ARROW_BYTES; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def whole_numbers(df: DataFrame, column: str) -> None:
    """An error unless the column holds whole numbers of at most 64 bits."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must hold whole numbers, not {kind}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_schema(df: DataFrame, more: str) -> str:
    """DDL of df's columns followed by more."""
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {more}" if own else more


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column's values, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **new: pa.Array) -> pa.RecordBatch:
    """batch without the columns in drop, then the new ones."""
    keep = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(new.values()), names=keep + list(new))


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about limit bytes of text at most; one longer text makes a piece."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if i > at and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(lengths):
            yield batch.slice(at)
    tidy()


def tidy() -> None:
    """Gives memory that is free back to the machine: a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def units_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts cut after every word: the code of each unit, what the codes stand for, and where texts end.

    A unit is a word with the blanks before it, or the blanks at the end of a text; the units of a
    text make up the text. The last array counts the units up to the end of each text. Null is empty.
    """
    column = pa.compute.fill_null(texts.cast(pa.string()), "")
    _, at, values = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    blank = _BLANK[data]
    is_end = np.zeros(len(data) + 1, bool)
    is_end[1:-1] = blank[1:] & ~blank[:-1]
    is_end[at] = True
    ends = np.flatnonzero(is_end[1:]) + 1
    places = np.concatenate([[0], ends]).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return cut.indices.to_numpy(), cut.dictionary.to_pylist(), np.searchsorted(ends, at[1:], "right")


def strung(codes: np.ndarray, values: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers that the codes stand for, one after another, and where each text's end (0 first)."""
    pool = np.frombuffer(b"".join(values), "<u4")
    sizes = np.array([len(v) for v in values], np.int64) // 4
    starts, n = np.cumsum(sizes) - sizes, sizes[codes]
    after = np.cumsum(n)
    total = int(after[-1]) if len(after) else 0
    flat = pool[np.repeat(starts[codes] - (after - n), n) + np.arange(total)]
    return flat, np.concatenate([[0], after])[np.concatenate([[0], ends])]
