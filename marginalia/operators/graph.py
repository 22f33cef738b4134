"""The chunk graph as tables of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import strip, wrap_label, word_count
from marginalia.sources.shared import among, few_first, written

#: Relations that make the hierarchy; the graph builder writes the first two.
RELATIONS = ("HAS_ROOT", "CONTAINS_SUBSECTION", "CONTAINS", "HAS_CHILD")


def edges(chunks: DataFrame) -> DataFrame:
    """document_id, src, dst, relation, ord: from a document to its top chunks, and from parents to children."""
    roots = chunks.filter("level = 1").select("document_id", F.col("document_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_ROOT").alias("relation"), F.col("pos").alias("ord"))
    kids = chunks.filter("parent_id IS NOT NULL").select("document_id", F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS_SUBSECTION").alias("relation"), F.col("pos").alias("ord"))
    return roots.unionByName(kids)


def counts(chunks: DataFrame) -> DataFrame:
    """document_id, graph_nodes (the document is one), graph_edges."""
    nodes = chunks.groupBy("document_id").agg((F.count("*") + 1).alias("graph_nodes"))
    lines = edges(chunks).select("document_id", "src", "dst").distinct().groupBy("document_id").agg(F.count("*").alias("graph_edges"))
    return nodes.join(lines, "document_id", "left").withColumn("graph_edges", F.coalesce("graph_edges", F.lit(0)))


def hierarchy(graph_edges: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    return graph_edges.filter(F.col("relation").isin(*relations))


def isolated(nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Nodes (id) without an edge."""
    ends = graph_edges.select(F.col("src").alias("id")).union(graph_edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def labels(nodes: DataFrame) -> DataFrame:
    """nodes with the label that a picture shows."""
    return nodes.withColumn("label", wrap_label("title"))


def _titled(title: Column, body: Column) -> Column:
    return F.when(title == "", body).otherwise(F.concat(F.lit("["), title, F.lit("]\n"), body))


def expand(hits: DataFrame, chunks: DataFrame, graph_edges: DataFrame, most: int = 6, least_words: int = 5, texts: DataFrame | None = None) -> DataFrame:
    """hits (document_id, chunk_id, text) with expanded_text and n_neighbors.

    Neighbours are parents, then children, each in edge order; short, missing, repeated ones and the
    hit itself do not count towards most. Only edges of the hits' documents are read. texts, if given, holds
    title and text by those of document_id, pos and chunk_id that it has, and chunks (with these) hold none; then
    neighbours are chosen by counts of words, and texts are joined to those that stay.
    """
    hit = hits.select("document_id", "chunk_id").distinct()
    up = graph_edges.select("document_id", F.col("dst").alias("chunk_id"), F.col("src").alias("near"), F.lit(0).alias("side"), "ord")
    down = graph_edges.select("document_id", F.col("src").alias("chunk_id"), F.col("dst").alias("near"), F.lit(1).alias("side"), "ord")
    near = hit.join(up.unionByName(down), ["document_id", "chunk_id"]).filter("near <> chunk_id")
    near = near.groupBy("document_id", "chunk_id", "near").agg(F.min(F.struct("side", "ord")).alias("at"))
    body = [strip("title").alias("t"), strip("text").alias("b")]
    if texts is None:
        nodes = chunks.select("document_id", F.col("chunk_id").alias("near"), *body).filter(word_count("b") > least_words)
    else:
        on = [c for c in ("document_id", "pos", "chunk_id") if c in texts.columns]
        nodes = chunks.select("document_id", F.col("chunk_id").alias("near"), *[F.col(c).alias(f"gx_{c}") for c in on])
    near = near.join(nodes, ["document_id", "near"])
    if texts is not None:
        near = written(near)
        keyed = texts.select("text", *[F.col(c).alias(f"gx_{c}") for c in on])
        keys = [f"gx_{c}" for c in on]
        near = near.join(among(keyed, near.select(*keys)).filter(word_count(strip("text")) > least_words).select(*keys), keys)
    order = Window.partitionBy("document_id", "chunk_id").orderBy("at", "near")
    near = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    if texts is not None:
        bodies = texts.select(*[F.col(c).alias(f"gy_{c}") for c in on], *body)
        near = few_first(near, bodies, [F.col(f"gx_{c}") == F.col(f"gy_{c}") for c in on])
    joined = near.groupBy("document_id", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", _titled(F.col("t"), F.col("b")).alias("x")))), lambda s: s["x"]).alias("blocks"))
    x = hits.join(joined, ["document_id", "chunk_id"], "left")
    more = F.concat(F.col("text"), F.lit("\n\n--- Related context ---\n\n"), F.array_join("blocks", "\n\n"))
    return x.withColumn("expanded_text", F.coalesce(more, F.col("text"))).withColumn("n_neighbors", F.coalesce(F.size("blocks"), F.lit(0))).drop("blocks")


def ancestors(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, ancestor_id, distance, up to the root of every tree; parents that make a circle are an error.

    By doubling: once the ancestors up to a distance are known, those of the one at that distance give the next as
    many. So a tree takes as many rounds as its depth has binary digits. Rounds are tables in the shared folder.
    """
    link = chunks.select("document_id", "chunk_id", F.col("parent_id").alias("ancestor_id")).filter("ancestor_id IS NOT NULL")
    jump, span = written(link), 1
    parts = [jump.withColumn("distance", F.lit(1))]
    while not jump.isEmpty():
        found = reduce(DataFrame.unionByName, parts)
        circle = parts[-1].filter("ancestor_id = chunk_id").select("document_id", "chunk_id").first()
        if circle:
            raise ValueError(f"chunk {circle['chunk_id']} of document {circle['document_id']} is its own ancestor")
        at = jump.withColumnRenamed("ancestor_id", "at")
        more = at.join(found.withColumnRenamed("chunk_id", "at"), ["document_id", "at"])
        parts.append(written(more.select("document_id", "chunk_id", "ancestor_id", (F.col("distance") + span).alias("distance"))))
        jump = parts[-1].filter(F.col("distance") == 2 * span).drop("distance")
        span *= 2
    return reduce(DataFrame.unionByName, parts)


def roots(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, root_id, depth: each chunk's topmost ancestor, itself for a root; a circle is an error.

    By pointer doubling: every chunk points to an ancestor, first its parent, and takes over what that one points
    to, so paths double with each round. Chunks that point to a top are set aside; a round is a table.
    """
    key = ["document_id", "at"]
    x = chunks.select("document_id", "chunk_id", F.coalesce("parent_id", "chunk_id").alias("at"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    open_, n = written(x), x.count()
    done = [open_.filter("depth = 0")]
    open_ = open_.filter("depth > 0")
    rounds = 0
    while not open_.isEmpty():
        if rounds > max(1, n).bit_length():
            raise ValueError("parents make a circle")
        known = reduce(DataFrame.unionByName, [*done[1:], open_])  # where each chunk but the tops points to by now
        up = known.select("document_id", F.col("chunk_id").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"))
        x = written(open_.join(up, key, "left").select("document_id", "chunk_id", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("to").isNull().alias("top")))
        done.append(x.filter("top").drop("top"))
        open_, rounds = x.filter("NOT top").drop("top"), rounds + 1
    return reduce(DataFrame.unionByName, done).withColumnRenamed("at", "root_id")
