"""N-gram Jaccard join of a corpus with itself by MinHash banding.

A document is the set of its n-grams of words, as 64-bit hashes. Documents with equal sets form a
class; a class is one node, whatever its size. Bands of MinHash rows, whose numbers follow from the
threshold and the wanted recall, go to buckets by their hash. Pairs of classes that share a bucket are
verified on their full sets, in one of two ways that between them cover every such pair:

* A bucket of up to small classes gives its pairs as such, each in the first band that the two share.
* The classes of larger buckets are dealt into blocks; each pair of blocks is compared in one task by
  products of 0/1 matrices, which gives link counts and a spanning forest, so that no pair of a large group
  is ever a row. What is compared together is either a bucket, of which each pair counts in the first band
  that it shares, or all buckets of a region (connected by their members) at once, where that is less
  work: in a group of near copies, which meet in most bands. A chain of buckets that have little in common
  goes bucket by bucket, so the work never exceeds the pairs that share a large bucket, counted by band.

Links of an exact copy to its like are counted, not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, sliced, whole_numbers
from marginalia.llm.graph import components

#: A table of groups is broadcast up to this many rows of three numbers; sets are then not shuffled by group.
BROADCAST_GROUPS = 200_000
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at the threshold share one with this chance."""
    best = (most, 1)
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most:
            best = bands, rows
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: _U) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(size, _P), _powers(size, _U(pow(int(_P), -1, 1 << 64)))
    return _POWERS[size]


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' n-gram sets, sorted, one after another, and where each begins (one entry more).

    A text of fewer than n words, but of one at least, has one n-gram of all its words.
    """
    with np.errstate(over="ignore"):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        power, inverse = _tables(len(data))
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)])])
        words = _mix((sums[end] - sums[start]) * inverse[start])
        at = np.cumsum([0] + [len(r) + 1 for r in raw])
        first = np.searchsorted(start, at)
        grams = np.zeros(max(0, len(words) - n + 1), _U)
        for k in range(n):
            grams = grams * _P + words[k : k + len(grams)]
        grams = _mix(grams)
        sets, bounds = [], [0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.unique(grams[a : b - n + 1])
            elif b > a:
                own = _mix(np.array([np.add.reduce(words[a:b] * power[1 : b - a + 1]) + _U(b - a)], _U))
            else:
                own = grams[:0]
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
        return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.array(bounds)


def sketch(texts: list[str], n: int, bands: int, rows: int) -> dict[str, np.ndarray]:
    """Of each text: two halves of its set's digest, the set's size, and its band hashes (0 if empty)."""
    sets, bounds = shingles(texts, n)
    size = np.diff(bounds)
    some = size > 0
    out = {"h1": np.zeros(len(texts), _U), "h2": np.zeros(len(texts), _U), "size": size, "bands": np.zeros((len(texts), bands), _U)}
    if not some.any():
        return out
    at = bounds[:-1][some]
    with np.errstate(over="ignore"):
        out["h1"][some] = _mix(np.add.reduceat(_mix(sets ^ _U(0x5851F42D4C957F2D)), at))
        out["h2"][some] = _mix(np.add.reduceat(_mix(sets + _U(0x14057B7EF767814F)), at) ^ size[some].astype(_U))
        state = np.random.default_rng(7)
        for b in range(bands):
            own = np.full(int(some.sum()), b, _U)
            for _ in range(rows):
                odd, add = (state.integers(1 << 63, dtype=_U) << _U(1)) | _U(1), state.integers(1 << 63, dtype=_U)
                own = _mix(own * _P + np.minimum.reduceat(sets * odd + add, at))
            out["bands"][some, b] = own
    return out


def compare(a: list[np.ndarray], b: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Which sets of a and b have this Jaccard similarity or more. Works through shared n-grams in chunks."""
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    vocab = np.intersect1d(flat_a, flat_b)
    col_a, col_b = (np.minimum(np.searchsorted(vocab, f), max(0, len(vocab) - 1)) for f in (flat_a, flat_b))
    both = np.zeros((len(a), len(b)), np.float32)
    if len(vocab):
        in_a, in_b = vocab[col_a] == flat_a, vocab[col_b] == flat_b
        row_a, col_a, row_b, col_b = row_a[in_a], col_a[in_a], row_b[in_b], col_b[in_b]
        for c in range(0, len(vocab), columns):
            part = []
            for rows, cols, n in ((row_a, col_a, len(a)), (row_b, col_b, len(b))):
                here = (cols >= c) & (cols < c + columns)
                m = np.zeros((n, min(columns, len(vocab) - c)), np.float32)
                m[rows[here], cols[here] - c] = 1
                part.append(m)
            both += part[0] @ part[1].T
    union = na[:, None] + nb[None, :] - both
    return both >= threshold * union - 1e-6


def region_kinds(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, region, whole: whether a region is compared at once, because that is no more pairs than its buckets have together.

    hot: band, bh, held, hub of the buckets; nodes: cc_node and cc_root of the classes in them.
    """
    regions = nodes.select(F.col("cc_node").alias("node"), F.col("cc_root").alias("region"))
    pairs = hot.join(regions, F.col("hub") == F.col("node")).groupBy("region").agg(F.sum(F.col("held").cast("double") * F.col("held")).alias("c"))
    n = regions.groupBy("region").agg(F.count("*").cast("double").alias("n"))
    return regions.join(n.join(pairs, "region").select("region", (F.col("n") * F.col("n") <= F.col("c")).alias("whole")), "region")


def _set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _U)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    small: int = 16,
    block: int = 1024,
    block_grams: int = 1 << 22,
) -> DataFrame:
    """One row a document: its id, class_id, copy_id, n_copies, n_links, n_text_links.

    class_id: the smallest id reachable over links; copy_id: the smallest id with the same n-gram set,
    and n_copies how many rows have it. n_links: rows of similarity threshold or more, the row itself not
    counted; n_text_links: different n-gram sets among them. small, block and block_grams steer the
    work, not the result: pairs are compared by rows in buckets of up to small classes, else in blocks
    of about block classes and block_grams n-grams.

    Words are runs without blanks, case as it is. A text of fewer than n words is one n-gram. A null
    text, or one without words, has no n-grams, is like nothing, and has itself as class and group. A
    null id is kept; it names a class or group only if no other id does. Repeated rows are copies.
    """
    whole_numbers(docs, id_col)
    bands, rows = choose_bands(threshold, recall)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, 1 << 20):
            x = sketch([t or "" for t in batch.column(text_col).to_pylist()], n, bands, rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col).cast(pa.int64()), pa.array(x["h1"].view(np.int64)), pa.array(x["h2"].view(np.int64)), pa.array(x["size"].astype(np.int64)),
                pa.FixedSizeListArray.from_arrays(pa.array(x["bands"].view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
            ], names=["id", "h1", "h2", "size", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    sig = source.mapInArrow(sketches, "id bigint, h1 bigint, h2 bigint, size bigint, bands array<bigint>")
    sig = checkpointed(sig.withColumn("uid", F.monotonically_increasing_id()))
    classes = checkpointed(
        sig.filter("size > 0").groupBy("h1", "h2").agg(
            F.min("uid").alias("node"), F.min("id").alias("copy_id"), F.count("*").alias("n_copies"),
            F.first("size").alias("size"), F.first("bands").alias("bands"))
    )
    inside = classes.select("node", "size", "bands", F.posexplode("bands").alias("band", "bh"))
    buckets = inside.groupBy("band", "bh").agg(F.count("*").alias("held"), F.min("node").alias("hub")).filter("held > 1")
    members = checkpointed(inside.join(buckets, ["band", "bh"]))
    large = members.filter(F.col("held") > small)
    regions = checkpointed(region_kinds(buckets.filter(F.col("held") > small), components(large.select(F.col("node").alias("a"), F.col("hub").alias("b")))))
    together = regions.filter("whole").select("node", "region")

    few = members.filter(F.col("held") <= small).select("band", "bh", "node", "size", "bands").join(together, "node", "left")
    x, y = (few.select("band", "bh", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "bands", "region")]) for s in "xy")
    first_shared = F.array_position(F.zip_with("bands_x", "bands_y", lambda p, q: p == q), True) == F.col("band") + 1
    pairs = x.join(y, ["band", "bh"]).filter(
        (F.col("node_x") < F.col("node_y")) & (F.least("size_x", "size_y") >= F.lit(threshold) * F.greatest("size_x", "size_y") - 1e-6)
        & ~F.coalesce(F.col("region_x") == F.col("region_y"), F.lit(False)) & first_shared
    ).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    pairs = checkpointed(pairs)

    wanted = regions.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = sig.select(F.col("uid").alias("node"), "id", "h1", "h2").join(wanted, "node").join(classes.select("node", "n_copies"), "node")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, 1 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            sets, bounds = shingles(texts, n)
            x = sketch(texts, n, 1, 1)
            cuts = [sets[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(x["h1"].view(np.int64)), pa.array(x["h2"].view(np.int64)), pa.array(cuts, pa.binary())], names=["id", "h1", "h2", "grams"])

    same = F.col("s.id").eqNullSafe(F.col("w.id"))
    chosen = source.join(wanted.select(F.col("id").alias("want")).distinct(), F.col(id_col).eqNullSafe(F.col("want")), "left_semi")
    sets = chosen.mapInArrow(grams, "id bigint, h1 bigint, h2 bigint, grams binary").alias("s").join(
        wanted.alias("w"), same & (F.col("s.h1") == F.col("w.h1")) & (F.col("s.h2") == F.col("w.h2"))
    ).select("node", "n_copies", "grams")
    sets = checkpointed(sets.dropDuplicates(["node"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                p, q = _set(p.as_py()), _set(q.as_py())
                shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                good.append(shared >= threshold * (len(p) + len(q) - shared) - 1e-6)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "copies_a", "copies_b"])

    side = lambda s: sets.select(F.col("node").alias(s), F.col("n_copies").alias(f"copies_{s}"), F.col("grams").alias(f"grams_{s}"))
    rows_ = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(verify, "a bigint, b bigint, copies_a bigint, copies_b bigint")
    single = checkpointed(rows_)

    by_region = together.select("node", F.col("region").alias("g"), F.lit(-1).alias("band"), F.lit(None).cast("array<bigint>").alias("bands"))
    by_bucket = large.join(regions.filter("NOT whole").select("node"), "node").select("node", F.col("bh").alias("g"), "band", "bands")
    groups = sets.withColumn("n", F.length("grams") / 8).join(by_region.unionByName(by_bucket), "node")
    dealt = groups.select("g", "band", "node", "n").groupBy("g", "band").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_grams)).cast("long").alias("parts"))
    dealt = checkpointed(dealt)
    if dealt.count() <= BROADCAST_GROUPS:
        dealt = F.broadcast(dealt)
    placed = groups.join(dealt, ["g", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("g", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n_copies", "grams", "bands")

    def cross(key: tuple, table: pa.Table) -> pa.Table:
        band, i, j = (k.as_py() for k in key[1:])
        own, node, copies = (table.column(c).to_numpy() for c in ("own", "node", "n_copies"))
        grams_ = [_set(g) for g in table.column("grams").to_pylist()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        texts, links, root = (np.zeros(len(node), np.int64) for _ in range(3))
        root[:] = node
        if len(left) and len(right):
            near = compare([grams_[k] for k in left], [grams_[k] for k in right], threshold)
            if i == j:
                np.fill_diagonal(near, False)
            if band > 0:  # pairs that share an earlier band are compared there
                hashes = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
                for earlier in range(band):
                    near &= hashes[left, earlier][:, None] != hashes[right, earlier][None, :]
            texts[left], links[left] = near.sum(1), near @ copies[right]
            if i != j:
                texts[right], links[right] = near.sum(0), near.T @ copies[left]
            while True:  # the least node each can reach within these two blocks
                was = root.copy()
                for ours, theirs, m in ((left, right, near), (right, left, near.T)):
                    for s in range(0, len(ours), 256):
                        part = np.where(m[s : s + 256], root[theirs][None, :], np.iinfo(np.int64).max)
                        root[ours[s : s + 256]] = np.minimum(root[ours[s : s + 256]], part.min(1))
                if (was == root).all():
                    break
        return pa.table({"node": node, "texts": texts, "links": links, "root": root})

    blocks = checkpointed(placed.groupBy("g", "band", "i", "j").applyInArrow(cross, "node bigint, texts bigint, links bigint, root bigint"))
    counted = blocks.select("node", "texts", "links").unionByName(
        single.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("texts"), F.col("copies_b").alias("links"))
    ).unionByName(single.select(F.col("b").alias("node"), F.lit(1).cast("long").alias("texts"), F.col("copies_a").alias("links")))
    counted = counted.groupBy("node").agg(F.sum("texts").alias("n_text_links"), F.sum("links").alias("far"))
    edges = blocks.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(single.select("a", "b"))
    linked = components(edges)
    grouped = classes.select("node", "copy_id", "n_copies", "h1", "h2").join(linked, F.col("node") == F.col("cc_node"), "left").withColumn("root", F.coalesce("cc_root", "node"))
    named = grouped.filter("cc_root is not null").groupBy("root").agg(F.min("copy_id").alias("least"))
    about = (
        grouped.join(named, "root", "left").join(counted, "node", "left")
        .select("h1", "h2", F.coalesce("least", "copy_id").alias("class_id"), "copy_id", "n_copies",
                (F.coalesce("far", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))
    )
    full = sig.filter("size > 0").select("id", "h1", "h2").join(about, ["h1", "h2"]).drop("h1", "h2")
    zero = F.lit(0).cast("long")
    empty = sig.filter("size = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), zero.alias("n_links"), zero.alias("n_text_links"))
    return full.unionByName(empty).withColumnRenamed("id", id_col)
