"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source waits in the source's queue, in the order of a hash. Its virtual finish
time is the tokens of its source up to and including it, divided by the source's target. Serving all
queues by finish time and stopping at the total budget takes from each source about its target. A
source whose target exceeds its size is served again from the start, up to max_repeat times.

Cumulative sums over a source of any size: hash buckets of the source are summed first (map-side
combined), their offsets are a window over at most n_buckets rows a source, and only the rows of one
bucket are sorted in one task; buckets grow in number with the rows. The truncation point is found by range refinement of the virtual-time
axis; the driver sees histograms of at most a few thousand rows. Because each source is served in the
order of its queue, the outcome is one cut a source, so that texts are never shuffled: they meet the
cuts in a join that is broadcast only after the number of sources has been checked.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, cleared, n_words

#: A table of sources is broadcast up to this many rows of some 100 bytes.
BROADCAST_SOURCES = 100_000

#: Rows of all sources for one of a source's hash buckets; there are 4096 buckets a source at least.
ROWS_A_BUCKET = 16_384


def _key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _size(text_col: str, size_col: str | None) -> Column:
    return F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else n_words(F.col(text_col))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    max_repeat: int = 2,
    seed: str = "mix",
    size_col: str | None = None,
) -> DataFrame:
    """One row a source: q_source, q_size, q_target, and the cut up to which its queue is served.

    Sources in code-point order, null last, have the weights in turn. The sources share budget times
    all sizes; a target stops at max_repeat times its source's size and the excess is shared by
    weight among the rest. An empty table gives no rows. Texts without words have size 0 and take
    nothing. Repeated rows count each; rows equal in id, source and size are interchangeable.
    With size_col sizes are read from that column (null: 0) and texts are not looked at.
    """
    none = F.col(source_col).isNull()
    slim = docs.select(
        none.cast("int").alias("q_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("q_source"),
        _size(text_col, size_col).alias("q_n"),
        _key(id_col, seed).alias("q_key"),
    )
    slim = checkpointed(slim)
    digits = max(3, math.ceil(math.log(max(1, slim.count() / ROWS_A_BUCKET), 16)))
    slim = slim.withColumn("q_bucket", F.substring("q_key", 1, digits))
    src, bucket = ["q_null", "q_source"], ["q_null", "q_source", "q_bucket"]
    sums = slim.groupBy(*bucket).agg(F.sum("q_n").alias("q_sum"))
    before = Window.partitionBy(*src).orderBy("q_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("q_before", F.coalesce(F.sum("q_sum").over(before), F.lit(0)))
    targets = checkpointed(_targets(sums.groupBy(*src).agg(F.sum("q_sum").alias("q_size")), weights, budget, max_repeat))
    total = targets.agg(F.sum("q_size")).first()[0] or 0
    within = Window.partitionBy(*bucket).orderBy("q_key", "q_n").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        slim.join(offsets.join(targets, src), bucket)
        .withColumn("q_done", F.col("q_before") + F.sum("q_n").over(within))
        .select(*src, "q_key", "q_n", *[
            ((F.col("q_done") + p * F.col("q_size")) / F.nullif("q_target", F.lit(0.0))).alias(f"q_time{p}")
            for p in range(max_repeat)
        ])
    )
    served = checkpointed(
        queued.filter("q_n > 0").select(*src, "q_key", "q_n", F.posexplode(F.array(*[f"q_time{p}" for p in range(max_repeat)])).alias("q_pass", "q_time"))
    )
    order = F.struct("q_time", "q_null", "q_source", "q_pass", "q_key", "q_n")
    last = _last_served(served, order, budget * total)
    taken = served.filter(last) if last is not None else served
    cuts = taken.groupBy(*src).agg(F.max(F.struct("q_pass", "q_key", "q_n")).alias("q_cut"))
    return checkpointed(targets.join(cuts, src, "left"))


def _targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_repeat: int) -> DataFrame:
    """Water filling in one pass: with the sources ordered by cap / weight, the capped ones come first."""
    by_name = Window.orderBy("q_null", "q_source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    x = sizes.withColumn("q_weight", w).withColumn("q_cap", max_repeat * F.col("q_size"))
    by_ratio = Window.orderBy((F.col("q_cap") / F.col("q_weight")), "q_null", "q_source")
    x = x.withColumn("q_caps", F.coalesce(F.sum("q_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("q_rest", F.sum("q_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy()
    x = x.withColumn("q_level", (F.lit(float(budget)) * F.sum("q_size").over(whole) - F.col("q_caps")) / F.col("q_rest"))
    fits = F.when(F.col("q_level") <= F.col("q_cap") / F.col("q_weight"), F.struct((F.col("q_cap") / F.col("q_weight")).alias("r"), "q_null", "q_source", "q_level"))
    x = x.withColumn("q_level", F.min(fits).over(whole)["q_level"])
    target = F.least(F.col("q_cap").cast("double"), F.coalesce(F.col("q_level") * F.col("q_weight"), F.col("q_cap").cast("double")))
    return x.select("q_null", "q_source", "q_size", target.alias("q_target"))


def _last_served(served: DataFrame, order: Column, budget: float, fan: int = 1024) -> Column | None:
    """The condition that holds for the rows served within budget; None if all are.

    Three levels of range buckets, each fan times finer, leave few rows to be put into exact order.
    """
    left, scale, inside = budget, 1, []
    for _ in range(3):
        scale *= fan
        slot = F.least(F.floor(F.col("q_time") * scale), F.lit(4 * scale))
        hist = reduce(DataFrame.filter, inside, served).groupBy(slot.alias("slot")).agg(F.sum("q_n").alias("n")).orderBy("slot").collect()
        for row in hist:
            if row["n"] > left + 0.5:
                break
            left -= row["n"]
        else:
            return None if not inside else _through(order, reduce(DataFrame.filter, inside, served), left)
        inside.append(slot == F.lit(row["slot"]))
    return _through(order, reduce(DataFrame.filter, inside, served), left)


def _through(order: Column, rows: DataFrame, left: float) -> Column:
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first_out = rows.withColumn("q_run", F.sum("q_n").over(running)).filter(F.col("q_run") > left + 0.5).agg(F.min(order).alias("o")).first()["o"]
    if first_out is None:
        top = rows.agg(F.max(order).alias("o")).first()["o"]
        return order <= _literal(top)
    return order < _literal(first_out)


def _literal(row) -> Column:
    return F.struct(
        F.lit(float(row["q_time"])).alias("q_time"), F.lit(int(row["q_null"])).alias("q_null"), F.lit(row["q_source"]).alias("q_source"),
        F.lit(int(row["q_pass"])).alias("q_pass"), F.lit(row["q_key"]).alias("q_key"), F.lit(row["q_n"]).cast("long").alias("q_n"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", size_col: str | None = None, **how) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the document).

    Columns of docs with these names give way; the others stay. See plan_mix for the rest.
    """
    docs, back = cleared(docs, ("mix_size", "mix_source_size", "mix_target", "mix_copies"), (id_col, size_col or text_col, source_col), "q_")
    plan = plan_mix(docs, id_col, text_col, source_col, seed=seed, size_col=size_col, **how)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    x = docs.withColumns({
        "q_null": F.col(source_col).isNull().cast("int"), "q_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "q_key": _key(id_col, seed),
    }).join(plan, ["q_null", "q_source"], "left")
    cut, size = F.col("q_cut"), _size(text_col, size_col)
    # the size decides between rows of one id alone, so that most texts need not be looked at again
    reached = (F.col("q_key") < cut["q_key"]) | ((F.col("q_key") == cut["q_key"]) & (size <= cut["q_n"]))
    copies = F.coalesce(cut["q_pass"] + reached.cast("int"), F.lit(0))
    x = x.withColumns({"mix_size": size, "mix_copies": copies, "mix_source_size": F.col("q_size"), "mix_target": F.col("q_target")})
    return back(x.drop("q_null", "q_source", "q_key", "q_size", "q_target", "q_cut"))
