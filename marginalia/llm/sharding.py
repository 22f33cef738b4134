"""Sharding by jump consistent hashing: a key and the number of shards decide, without a ring table.

A key's hash seeds a linear congruential generator of 64 bits (Lamping and Veach, "A Fast, Minimal Memory,
Consistent Hash Algorithm"). Each of its numbers is a jump to the next shard that takes the key over while
shards are appended one by one; the last jump below the number of shards is the key's shard. So appending
shards takes keys into the new shards only, each with its due part.

Within a shard, rows are numbered without a gap in the order of their keys. The rows, by then without
texts, are sorted into ranges whose borders may lie inside one key, and the small counts of a shard's rows
a range give where each range begins: no task holds a shard or a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import cleared, let, written

#: The generator's factor, in halves of 32 bits. A fixed value of the published algorithm.
FACTOR = 2862933555777941757
_HIGH, _LOW, _MASK = FACTOR >> 32, FACTOR & 0xFFFFFFFF, 0xFFFFFFFF
#: Jumps after which the rare key that needs more takes them in a second pass: some ln(shards) are needed.
JUMPS = 64
#: Rows that a range has at most, about.
ROWS_A_RANGE = 1_000_000


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _low_product(a: Column, b: int) -> Column:
    """The lower 32 bits of a * b, for numbers of 32 bits, without leaving 63 bits."""
    return (a * _long(b & 0xFFFF) + F.shiftleft((a * _long(b >> 16)).bitwiseAND(_long(0xFFFF)), 16)).bitwiseAND(_long(_MASK))


def _jumped(state: Column, shards: int) -> Column:
    """The state one jump on, or as it is once the next jump is beyond the shards."""
    high, low, at = state["high"], state["low"], state["next"]
    first = (low.bitwiseAND(_long(0xFFFF)) * _long(_LOW)) + _long(1)
    second = F.shiftrightunsigned(low, 16) * _long(_LOW) + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(_long(0xFFFF)), 16).bitwiseOR(first.bitwiseAND(_long(0xFFFF)))
    new_high = (F.shiftrightunsigned(second, 16) + _low_product(high, _LOW) + _low_product(low, _HIGH)).bitwiseAND(_long(_MASK))
    to = lambda h: F.floor((at + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(h, 1) + 1).cast("double")))
    new = let(new_high, lambda h: F.struct(h.alias("high"), new_low.alias("low"), at.alias("shard"), to(h).alias("next")))
    return F.when(at < shards, new).otherwise(state)


def jump(key: Column, shards: int) -> Column:
    """The shard of a key among shards, and the number of shards beyond which it moves on: a struct of shard, next.

    Keys of any type count by their text, null as the empty one; its MD5's first 64 bits are the seed.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    start = let(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), lambda h: F.struct(half(h, 1).alias("high"), half(h, 9).alias("low"), _long(-1).alias("shard"), _long(0).alias("next")))
    run = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: _jumped(s, shards))
    done = run(start, min(shards, JUMPS))
    if shards > JUMPS:  # every jump goes up by one at least, so shards of them suffice
        done = let(done, lambda s: F.when(s["next"] < shards, run(s, shards - JUMPS)).otherwise(s))
    return done


def placed(docs: DataFrame, shards: int, key_col: str = "doc_id", grown: int | None = None) -> DataFrame:
    """docs with shard, and with grown also grown_shard: the shard among that many. Own columns of these names give way."""
    new = ("shard",) if grown is None else ("shard", "grown_shard")
    x, back = cleared(docs, new, (key_col,), "sh_")
    x = x.withColumn("sh_at", jump(F.col(key_col), shards)).withColumn("shard", F.col("sh_at.shard").cast("int"))
    if grown == shards + 1:
        x = x.withColumn("grown_shard", F.when(F.col("sh_at.next") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    elif grown is not None:
        x = x.withColumn("grown_shard", jump(F.col(key_col), grown)["shard"].cast("int"))
    return back(x.drop("sh_at"))


def moved(docs: DataFrame, shards: int, grown: int, key_col: str = "doc_id") -> DataFrame:
    """The rows that appending shards moves, with the shard they leave and, in grown_shard, the new one they go to: all that has to be copied."""
    if grown < shards:
        raise ValueError("shards are appended, not taken away")
    return placed(docs, shards, key_col, grown).filter("grown_shard <> shard")


def write_shards(docs: DataFrame, path: str, shards: int, key_col: str = "doc_id", files: int | None = None) -> None:
    """Writes docs to Parquet folders shard=0, shard=1 and so on, each in the order of keys, in about files files.

    A large shard or key is several files: ranges of the rows' order are cut anywhere. Shards without rows have no folder.
    """
    x = placed(docs, shards, key_col).withColumn("sh_tie", F.monotonically_increasing_id())
    keys = ("shard", key_col, "sh_tie")
    x.repartitionByRange(files or max(shards, _partitions(docs)), *keys).sortWithinPartitions(*keys).drop("sh_tie").write.partitionBy("shard").parquet(path)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sharded(docs: DataFrame, shards: int = 24, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: key_col, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) and eight more, text_crc32 its checksum; grown_shard is the
    shard once one more is appended. slot numbers a shard's rows from 0 in the order of key (null first),
    size and checksum, so that rows which are alike in them may be taken for one another and reruns agree.
    Rows of one key are in one shard, those of null key too; equal texts are not kept together. An empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    slim = docs.select(F.col(key_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = written(placed(slim, shards, key_col, shards + 1).withColumn("tie", F.monotonically_increasing_id()))
    keys = ("shard", key_col, "size", "text_crc32", "tie")  # the tie lets a range end inside rows that are alike
    ranges = max(_partitions(slim), math.ceil(slim.count() / ROWS_A_RANGE))
    placed_at = F.monotonically_increasing_id()  # of a sorted range: its number and the row's place in it
    ordered = written(slim.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", placed_at).drop("tie"))
    ordered = ordered.withColumn("range", F.shiftright("at", 33))
    ends = ordered.groupBy("range", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("range", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    # at most ranges + shards rows, as sorted ranges meet a shard's border once
    out = ordered.join(F.broadcast(starts), ["range", "shard"]).withColumn("slot", F.col("at") + F.col("start"))
    return out.select(key_col, "size", "text_crc32", "shard", "slot", "grown_shard")
