"""Line dedup over a corpus with a pair of Bloom filters.

One pass over the texts takes down the digest of every line that is long enough. The filters, "once"
for what was seen and "twice" for what came again, are cut into ranges of the hash; each range has one
owner, to which tasks send every hash of a batch once, with a mark if the batch has it in two documents.
A line that is not in the "twice" filter occurs in one document only and stays where it is. The digests
of the others, the suspects, are shuffled for the exact count and the first occurrence. Only documents
that lose a line meet the verdicts in a join; all others stay in the JVM and are not shuffled.

The filters grow with the number of lines. As long as the "twice" filter is small it is broadcast to the
digests; beyond that the digests go to the owners of the ranges, except those that a batch has in two
documents, which are suspects anyway, so that no line makes an owner's share large.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, cleared, row_schema, sliced, with_columns, written

#: Bytes that are stripped at both ends of a line.
ENDS = b" \t\n\x0b\x0c\r"
#: Bits of the filter of one range.
RANGE_BITS = 1 << 23
#: The "twice" filter is broadcast up to so many bytes.
BROADCAST_BYTES = 1 << 27
#: Keys that so large a share of all suspects has that they are broadcast, not shuffled, are this many at most.
HOT_KEYS = 1000
#: Buckets of ids, of which those with a document that loses a line are broadcast.
ID_BUCKETS = 1 << 20
#: Bytes of a digest.
DIGEST = 16


def key_of(line: bytes) -> bytes:
    """A line's key: stripped at both ends, A-Z lower-cased."""
    return line.strip(ENDS).lower()


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    """Keys of at least min_chars code points."""
    found = set(map(bytes.strip, (text or "").encode().lower().split(b"\n")))
    return {k for k in found if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


def digest(key: bytes) -> bytes:
    """What stands for a key: 128 bits of BLAKE2."""
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def _places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit positions within a range, a row for each pair of halves of a digest."""
    return ((hashes[:, :1] + np.arange(probes, dtype=np.uint64) * (hashes[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bitmap, flat >> 3, (1 << (flat & 7)).astype(np.uint8))


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each digest, by its first bits; ranges is a power of two."""
    return (hashes[:, 0] >> np.uint64(40)).astype(np.int64) & (ranges - 1)


class _Batch:
    """The digests of some documents: which document has each, as halves, and as one value to sort by."""

    def __init__(self, keys: pa.Array):
        data = b"".join(keys.to_pylist())
        self.whole = np.frombuffer(data, f"V{DIGEST}")
        self.halves = np.frombuffer(data, "<u8").reshape(-1, 2)
        sizes = np.array([len(k) // DIGEST for k in keys.to_pylist()], np.int64)
        self.row = np.repeat(np.arange(len(keys)), sizes)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first of each digest, whether the batch has it again, and for each digest the number of its first."""
        order = np.lexsort((self.halves[:, 1], self.halves[:, 0]))
        sorted_ = self.halves[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(1)
        group = np.cumsum(new) - 1
        of = np.empty(len(order), np.int64)
        of[order] = group
        return order[new], np.bincount(group, minlength=int(new.sum())) > 1, of


def twice_filters(digests: DataFrame, ranges: int, bits: int, probes: int) -> DataFrame:
    """Rows range, twice (compressed): the filter of what came again, of each range that has any."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch.column("lb_keys"))
            first, again, _ = b.distinct()
            halves, at = b.halves[first], _range(b.halves[first], ranges)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            for part in np.split(order, cuts[1:]) if len(order) else []:
                yield pa.RecordBatch.from_pydict({"range": [int(at[part[0]])], "halves": [halves[part].tobytes()], "again": [np.packbits(again[part]).tobytes()]})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None and twice.any():
                yield pa.RecordBatch.from_pydict({"range": [held], "twice": [zlib.compress(twice.tobytes(), 1)]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != held:
                    yield from done()
                    held, once, twice = row["range"], np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
                halves = np.frombuffer(row["halves"], "<u8").reshape(-1, 2)
                again = np.unpackbits(np.frombuffer(row["again"], np.uint8), count=len(halves)).astype(bool)
                places = _places(halves, bits, probes)
                _put(twice, places[again | _has(once, places)])
                _put(once, places)
        yield from done()

    sent = digests.select("lb_keys").mapInArrow(send, "range bigint, halves binary, again binary")
    return sent.repartition("range").sortWithinPartitions("range").mapInArrow(fill, "range bigint, twice binary")


def _suspects(digests: DataFrame, filters: DataFrame, ranges: int, bits: int, probes: int, broadcast_bytes: int) -> DataFrame:
    """lb_id, lb_key: every digest of every document that the "twice" filters hold, by whichever way is open."""
    kind = digests.schema["lb_id"].dataType.simpleString()
    out = f"lb_id {kind}, lb_key binary"

    def rows(ids: pa.Array, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([k.tobytes() for k in keys], pa.binary())], names=["lb_id", "lb_key"])

    if ranges * bits // 8 <= broadcast_bytes:
        sent = digests.sparkSession.sparkContext.broadcast({r["range"]: bytes(r["twice"]) for r in filters.toLocalIterator()})

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = _Batch(batch.column("lb_keys"))
                first, again, of = b.distinct()
                hit = again.copy()
                at = _range(b.halves[first], ranges)
                for r in np.unique(at[~again]).tolist():
                    if (bitmap := _loaded(sent.value, r)) is not None:
                        here = np.flatnonzero((at == r) & ~again)
                        hit[here] = _has(bitmap, _places(b.halves[first[here]], bits, probes))
                pick = np.flatnonzero(hit[of])
                yield rows(batch.column("lb_id").take(pa.array(b.row[pick])), b.whole[pick])

        return digests.mapInArrow(look, out)

    def part(alone: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = _Batch(batch.column("lb_keys"))
                _, again, of = b.distinct()
                pick = np.flatnonzero(again[of] != alone)
                ids = batch.column("lb_id").take(pa.array(b.row[pick]))
                x = rows(ids, b.whole[pick])
                yield with_columns(x, range=pa.array(_range(b.halves[pick], ranges)), twice=pa.nulls(len(pick), pa.binary())) if alone else x

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bitmap = None, None
        for batch in batches:  # the filter of a range comes before its digests
            at = batch.column("range").to_numpy()
            twice = batch.column("twice")
            for a, z in _stretches(at):
                if twice[a].is_valid:
                    held, bitmap = int(at[a]), np.frombuffer(zlib.decompress(twice[a].as_py()), np.uint8)
                    a += 1
                if a < z and held == int(at[a]):
                    some = batch.slice(a, z - a)
                    hit = _has(bitmap, _places(np.frombuffer(b"".join(some.column("lb_key").to_pylist()), "<u8").reshape(-1, 2), bits, probes))
                    yield some.select(["lb_id", "lb_key"]).filter(pa.array(hit))

    blank = filters.select(F.lit(None).cast(kind).alias("lb_id"), F.lit(None).cast("binary").alias("lb_key"), "range", "twice")
    single = digests.mapInArrow(part(True), f"{out}, range bigint, twice binary").unionByName(blank)
    single = single.withColumn("later", F.col("twice").isNull()).repartition("range").sortWithinPartitions("range", "later").drop("later")
    return digests.mapInArrow(part(False), out).unionByName(single.mapInArrow(meet, out))


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True) if len(values) else ()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits_per_line: int = 16, probes: int = 4, range_bits: int = RANGE_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with repeated lines removed from the text, and the counts n_lines and n_dropped.

    Texts are split at newlines; a null or empty text is one empty line and becomes the empty text. A
    key of min_chars code points or more that at least two documents hold loses all its lines except
    those of the smallest id, of any type that has an order. Rows of one id count as one document; those
    of a null id are one that comes after all others. Other columns stay as they are; columns called
    n_lines or n_dropped give way. An empty table stays empty. The last four parameters steer the work, not
    the result.
    """
    docs, back = cleared(docs, ("n_lines", "n_dropped"), (id_col, text_col), "lb_")
    id_type = docs.schema[id_col].dataType.simpleString()

    def taken_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            keys = [b"".join(map(digest, sorted(keys_of(t, min_chars)))) for t in batch.column(text_col).to_pylist()]
            some = pa.array([bool(k) for k in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(keys, pa.binary())], names=["lb_id", "lb_keys"]).filter(some)

    digests = written(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(taken_down, f"lb_id {id_type}, lb_keys binary"))
    n_keys = (digests.agg(F.sum(F.length("lb_keys"))).first()[0] or 0) // DIGEST
    ranges = 1 << max(0, (-(-n_keys * bits_per_line // range_bits) - 1).bit_length())
    filters = checkpointed(twice_filters(digests, ranges, range_bits, probes))
    suspects = checkpointed(_suspects(digests, filters, ranges, range_bits, probes, broadcast_bytes))
    first = suspects.groupBy("lb_key").agg(F.min("lb_id").alias("lb_first"), F.max("lb_id").alias("lb_other"), F.max(F.col("lb_id").isNull()).alias("lb_none"), F.count("*").alias("lb_n"))
    first = checkpointed(first.filter("lb_first < lb_other OR (lb_none AND lb_first IS NOT NULL)").drop("lb_other", "lb_none"))
    often = max(1000, suspects.count() // HOT_KEYS)  # so that at most HOT_KEYS keys are hot
    hot, cold = F.broadcast(first.filter(F.col("lb_n") >= often)), first.filter(F.col("lb_n") < often)
    held = suspects.join(hot, "lb_key").unionByName(suspects.join(hot.select("lb_key"), "lb_key", "left_anti").join(cold, "lb_key"))
    drops = held.filter("lb_id IS NULL OR lb_id > lb_first").groupBy("lb_id").agg(F.collect_set("lb_key").alias("lb_drop"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    drops = checkpointed(drops.withColumn("lb_bucket", bucket("lb_id")))
    losing = F.broadcast(drops.select("lb_bucket").distinct())  # at most ID_BUCKETS numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(text_col).to_pylist(), batch.column("lb_drop").to_pylist(), strict=True):
                own = (text or "").encode().split(b"\n")
                gone = set(drop or ())
                kept = [x for x in own if digest(key_of(x)) not in gone] if gone else own
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(kept))
            batch = batch.set_column(batch.schema.names.index(text_col), text_col, pa.array(texts, batch.schema.field(text_col).type))
            yield with_columns(batch, ("lb_drop",), n_lines=pa.array(n_lines, pa.int64()), n_dropped=pa.array(n_dropped, pa.int64()))

    placed = docs.withColumn("lb_bucket", bucket(id_col))
    text = F.coalesce(text_col, F.lit(""))
    alone = placed.join(losing, "lb_bucket", "left_anti").drop("lb_bucket").withColumns(
        {text_col: text, "n_lines": F.size(F.split(text, "\n")).cast("long"), "n_dropped": F.lit(0).cast("long")})
    met = placed.join(losing, "lb_bucket", "left_semi").drop("lb_bucket").join(drops.drop("lb_bucket"), F.col(id_col).eqNullSafe(F.col("lb_id")), "left").drop("lb_id")
    return back(alone.unionByName(met.mapInArrow(cut, row_schema(docs, "n_lines bigint, n_dropped bigint"))))


_HELD: dict[int, np.ndarray] = {}
_FROM: list[object] = []


def _loaded(blocks: dict[int, bytes], r: int) -> np.ndarray | None:
    """The broadcast filter of a range, unpacked once in each worker."""
    if not _FROM or _FROM[0] is not blocks:
        _FROM[:] = [blocks]
        _HELD.clear()
    if r not in _HELD and r in blocks:
        _HELD[r] = np.frombuffer(zlib.decompress(blocks[r]), np.uint8)
    return _HELD.get(r)
