"""The entries of one large JSON map, read in byte ranges.

The map is one file, or a folder of files that are its text when they are put together in the order of their
names, as a sorted table of lines is written; all but the last end with a closing brace.
Spark reads files in splits, cut behind closing braces. Whether a split begins inside a string, and at what
depth of nesting, follows from the splits before it: a first pass notes for each split the parity of its quotes
and by how much the depth changes inside and outside of strings, a few numbers a split that are added up in
order. A second pass cuts each split at the borders of entries. An entry that lies across splits is put
together from their ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import written

_PIECE = "block string, nth bigint, begun boolean, ended boolean, wanted boolean, last boolean, text string"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, bytes]]:
    """Which split it is, whether it is a new one, and the next of its bytes."""
    before = None
    for batch in batches:
        block_of = batch.column("block").dictionary_encode()
        starts = block_of.indices.to_numpy()
        for at in np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1]])).tolist() if len(starts) else ():
            block = block_of[at].as_py()
            rows = batch.column("value").slice(at, int((starts[at:] == starts[at]).sum())).to_pylist()
            yield block, block != before, "".join(f"{r}}}" for r in rows).encode()
            before = block


def _scan(data: bytes, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, which of them lie inside strings, and the change of depth at each, in strings or out."""
    x = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(x == 34)
    plain = np.maximum.accumulate(np.where(x != 92, np.arange(len(x)), -1))
    before = np.where(quote > 0, plain[np.maximum(quote - 1, 0)], -1)
    flips = np.zeros(len(x), np.int8)
    flips[quote[(quote - 1 - before) % 2 == 0]] = 1  # not behind an odd number of backslashes
    inside = ((np.cumsum(flips) + in_string) & 1).astype(bool)
    return x, inside, ((x == 123) | (x == 91)).astype(np.int8) - ((x == 125) | (x == 93)).astype(np.int8)


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split the parity of its quotes and the changes of depth, for either beginning."""
    found: dict[str, list[int]] = {}
    for block, _, data in _splits(batches):
        note = found.setdefault(block, [0, 0, 0])
        x, inside, step = _scan(data, note[0])
        flat, deep = int(step[~inside].sum()), int(step[inside].sum())
        note[1], note[2] = note[1] + flat, note[2] + deep
        note[0] = int(inside[-1]) if len(x) else note[0]
    names = ("block", "parity", "outside", "within")
    yield pa.RecordBatch.from_pydict({n: pa.array([k if n == "block" else v[i - 1] for k, v in found.items()], pa.string() if n == "block" else pa.int64()) for i, n in enumerate(names)})


def _cutter(begins: dict[str, tuple[int, int]], key: str):
    """The function that cuts splits at the borders of entries; begins: of each split whether it begins in a string, and the depth."""
    opening = re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*\Z')

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nth, begun, wanted, block, rows = [], 0, False, None, None, []

        def row(ended: bool, last: bool = False) -> None:
            rows.append((block, nth, begun, ended, wanted, last, b"".join(held).decode()))

        def table() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=[c.split(" ")[0] for c in _PIECE.split(", ")])
            rows.clear()
            return out

        for at, new, data in _splits(batches):
            if new:
                if block is not None:
                    row(False, last=True)
                block, (in_string, depth) = at, begins[at]
                held, nth, begun, wanted = [], 0, False, None
            x, inside, step = _scan(data, in_string)
            outside = ~inside
            depths = depth + np.cumsum(np.where(outside, step, 0))
            border = outside & (((x == 123) & (depths == 2)) | ((x == 44) & (depths == 2)) | ((x == 125) & (depths == 1)))
            begin = 0
            for to in np.flatnonzero(border).tolist():
                held.append(data[begin:to])
                begin = to + 1
                if x[to] == 123:  # a map of entries begins
                    wanted = bool(opening.search(b"".join(held)[-len(key) - 1000 :]))
                    held, begun = [], True
                else:
                    row(True)
                    held, nth, begun = [], nth + 1, True
            held.append(data[begin:])
            in_string, depth = int(inside[-1]), int(depths[-1])
            if rows:
                yield table()
        if block is not None:
            row(False, last=True)
        yield table()

    return cut


def map_entries(spark: SparkSession, path: str, key: str) -> DataFrame:
    """value: a map of one entry, as JSON, for each entry of the map that the file's map has under key.

    The file, or the files of the folder together, are one JSON map in UTF-8, of any size; an entry must fit in memory.
    Its other values are passed over.
    """
    block = F.concat("_metadata.file_name", F.lit(" "), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    lines = spark.read.option("lineSep", "}").text(path).select(block.alias("block"), "value")
    notes = sorted(lines.mapInArrow(_noted, "block string, parity bigint, outside bigint, within bigint").collect())  # a row a split
    begins, in_string, depth = {}, 0, 0
    for n in notes:
        begins[n.block] = (in_string, depth)
        depth += n.within if in_string else n.outside
        in_string ^= n.parity
    pieces = written(lines.mapInArrow(_cutter(begins, key), _PIECE))
    order = Window.orderBy("block")  # a row a split
    state = pieces.filter("last").select("block", F.last("wanted", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"))
    pieces = pieces.join(F.broadcast(state), "block").filter(F.coalesce("wanted", "from_before", F.lit(False))).drop("from_before")
    inner = pieces.filter("begun AND ended").select("text")
    edge = pieces.filter("NOT (begun AND ended)")
    group = F.sum(F.col("begun").cast("int")).over(Window.orderBy("block", "nth"))  # two rows a split at most, without their texts
    ends = edge.select("block", "nth", group.alias("group"))
    joined = edge.join(F.broadcast(ends), ["block", "nth"]).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "text"))).alias("parts"))
    across = joined.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    found = reduce(DataFrame.unionByName, (inner, across)).filter(F.col("text").rlike(r'\A\s*"'))
    return found.select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value"))
