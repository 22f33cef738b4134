"""Readers of stores and archives. What needs a library that is not here, such as a PDF reader, is passed in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import clean_page, garbage, text
from marginalia.sources.large_json import map_entries

#: The archive's own folder, which paths do not show; a fixed value.
OWN_FOLDER = "egyankosh"
PAGES = "path string, page_no int, text string, error string"
#: What a master index says of a document.
ENTRY = (
    "unit_title string, block_label string, source_pdf string, store_path string, total_pages int, total_chunks int, total_words int, "
    "graph_nodes int, graph_edges int, embedding_model string, embedding_dim int, force_ocr boolean"
)


def files(spark: SparkSession, root: str, pattern: str = "*.pdf", own_folder: str = OWN_FOLDER) -> DataFrame:
    """path, relative_path, length of the files below root whose names fit, in any folder; folders called own_folder are left out of relative_path."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    folder = re.sub(r"\Afile:/+", "/", root).rstrip("/")
    below = F.regexp_replace("path", r"\A.*?\Q" + folder + r"\E/?", "")
    parts = F.filter(F.split(below, "/"), lambda p: (F.lower(p) != own_folder) & (p != ""))
    return x.withColumn("relative_path", F.array_join(parts, "/"))


def pages(
    spark: SparkSession, root: str, reader: Callable[[bytes], list[str]], pattern: str = "*.pdf", recognise: Callable[[bytes, int], str] | None = None, force: bool = False
) -> DataFrame:
    """PAGES of each file, by a reader from bytes to pages; a file that fails gives one row with the error.

    recognise, from bytes and a page's place in the file (from 0) to its text, is asked for the pages that
    are garbage as the reader has them, or for all with force; a page on which it fails is empty. Pages are
    cleaned, and those that become empty are left out; page_no counts those that stay.
    """

    def again(data: bytes, place: int, page: str) -> str:
        if recognise is None or not (force or garbage(page.strip())):
            return page
        try:
            return recognise(data, place)
        except Exception:  # one bad page must not cost the file
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found, error = [(k, again(row["content"], k, t)) for k, t in enumerate(reader(row["content"]))], None
                except Exception as e:  # one bad file must not end the run
                    found, error = [(-1, None)], f"{type(e).__name__}: {e}"
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * n), pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string()), pa.array([error] * n, pa.string())], names=["path", "page_no", "text", "error"])

    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    x = source.mapInArrow(run, PAGES).withColumn("text", F.when(F.col("error").isNull(), clean_page("text"))).filter("error IS NOT NULL OR text <> ''")
    order = Window.partitionBy("path").orderBy("page_no")
    return x.withColumn("page_no", F.when(F.col("error").isNull(), F.row_number().over(order)))


def full_texts(page_rows: DataFrame, sep: str = "\n\n") -> DataFrame:
    """path, total_pages, full_text."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return page_rows.filter("error IS NULL").groupBy("path").agg(F.count("*").alias("total_pages"), F.array_join(F.transform(rows, lambda r: r["text"]), sep).alias("full_text"))


def master_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row a document of a master index: one file, or a folder of its parts in order, with a map from id to metadata under documents, or with lines a JSON object a line.

    Either is read in byte ranges.
    """
    if lines:
        return spark.read.schema(f"document_id string, {ENTRY}").json(path)
    x = map_entries(spark, path, "documents").select(F.from_json("value", f"map<string, struct<{ENTRY}>>").alias("m"))
    return x.select(F.explode("m").alias("document_id", "d")).select("document_id", "d.*")


def citations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and citation text of citation files: a list, or a list under citations, items or quotes, or the values of a map."""
    x = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    get = lambda p: F.try_variant_get("v", p, "array<variant>")
    values = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    items = F.coalesce(get("$"), get("$.citations"), get("$.items"), get("$.quotes"), values)
    field = lambda i, n: F.nullif(F.try_variant_get(i, f"$.{n}", "string"), F.lit(""))
    said = lambda i: F.coalesce(field(i, "citation_text"), field(i, "text"), field(i, "quote"), field(i, "citation"), F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")))
    x = x.select("path", F.explode(F.transform(items, said)).alias("citation_text"))
    return x.filter(text("citation_text") != "")


def nearest(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of wanted (folder) the rows of found (folder, …) in it, or in the closest folder above that has any."""
    up = wanted.select(F.col("folder").alias("want"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))).alias("folder"))
    x = up.join(found, "folder").withColumn("depth", F.size(F.split("folder", "/")))
    return x.withColumn("closest", F.max("depth").over(Window.partitionBy("want"))).filter("depth = closest").drop("closest", "depth")


def resolved(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """documents (document_id, store_path) with folder: their path if it is listed, else the first listed folder of the document's name."""
    direct = documents.join(listing.select(F.col("folder").alias("f1")).distinct(), F.col("store_path") == F.col("f1"), "left")
    name = F.element_at(F.split("folder", "/"), -1)
    first = listing.groupBy(name.alias("n")).agg(F.min("folder").alias("f2"))
    return direct.join(first, F.col("document_id") == F.col("n"), "left").withColumn("folder", F.coalesce("f1", "f2")).drop("f1", "f2", "n")


def payload(chunks: DataFrame, vectors: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Chunks beside their vectors by document and position; documents whose counts differ fail the job."""
    a = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    b = vectors.groupBy("document_id").agg(F.count("*").alias("n_vectors"))
    ok = a.join(b, "document_id", "left").withColumn("ok", F.assert_true(F.col("n_chunks") == F.coalesce("n_vectors", F.lit(0)), F.concat(F.lit("chunks and vectors differ: "), F.col("document_id").cast("string"))))
    x = chunks.join(vectors, ["document_id", "pos"]).join(ok.filter("ok IS NULL").select("document_id"), "document_id")
    if edges is not None:
        x = x.join(edges.groupBy("document_id").agg(F.count("*").alias("n_edges")), "document_id", "left")
    return x


def chapters(spark: SparkSession, path: str, subject: str, language: str) -> DataFrame:
    """chapter, of a manifest from subject to language to list; none for an unknown subject, an error for an unknown language."""
    if language not in ("en", "hi"):
        raise ValueError(f"language {language!r} is neither en nor hi")
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, array<string>>>").alias("m"))
    return x.select(F.explode(F.try_element_at(F.try_element_at("m", F.lit(subject)), F.lit(language))).alias("chapter"))
