"""From page texts to chunk tables, graph and catalog."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import block_label, document_id, embedding_input
from marginalia.operators import catalog, chunking, graph
from marginalia.operators.ordering import numbered


def documents(texts: DataFrame) -> DataFrame:
    """texts (path, full_text) to document_id, folder, stem, label, path, full_text; labels are distinct within a folder."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    x = texts.withColumns({"stem": F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""), "folder": F.regexp_extract("path", r"\A(.*)/", 1)})
    x = x.withColumns({"label": block_label("stem", "full_text"), "document_id": document_id("path", "stem")})
    return catalog.distinct_labels(x)


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents, cleaned up, with parents and children."""
    return chunking.post_process(chunking.chunk(docs.select("document_id", "full_text")))


def embed(chunk_rows: DataFrame, model: Callable[[list[str]], list[list[float]]], unit: bool = True) -> DataFrame:
    """chunk_rows with embedding, by a model from texts to vectors, in Arrow batches; of length 1 with unit, a zero vector as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model(batch.column("embedding_input").to_pylist())
            if unit:
                vectors = [[x / n for x in v] if (n := math.sqrt(sum(x * x for x in v))) else v for v in vectors]
            names = [n for n in batch.schema.names if n != "embedding_input"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunk_rows.schema.fields)
    return chunk_rows.withColumn("embedding_input", embedding_input("title", "text")).mapInArrow(run, f"{fields}, embedding array<float>")


def index(docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """The catalog: documents with their counts."""
    x = docs.drop("full_text").join(catalog.document_stats(chunk_rows), "document_id").join(graph.counts(chunk_rows), "document_id")
    return numbered(x, ("path",), "catalog_pos")
