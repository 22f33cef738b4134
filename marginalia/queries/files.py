"""Queries of readers and writers: tables are written to files in the shared folder and read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import word_count
from marginalia.operators import store
from marginalia.queries.registry import Tables, clean_page_sql, fingerprint, query, strip_sql, words
from marginalia.sources import pages, readers, writers
from marginalia.sources.shared import scratch

#: Documents of a source that make one file.
A_FILE = 500
_BUCKET = f"doc_id // {A_FILE}"


def _placed(x: Tables, *columns) -> DataFrame:
    """Documents with the folders that they are written to."""
    return x.documents.select("source", F.floor(F.col("doc_id") / A_FILE).alias("bucket"), "doc_id", *columns)


def _archive(x: Tables) -> str:
    """An archive whose files are documents of a source, one a page, with a form feed after each."""
    path = scratch(x.spark, "archive")
    rows = _placed(x, F.coalesce("text", F.lit("")).alias("text")).repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id")
    rows.drop("doc_id").write.partitionBy("source", "bucket").option("lineSep", "\f").text(path)
    return path


def _pages(x: Tables, **how) -> DataFrame:
    return readers.pages(x.spark, _archive(x), lambda data: data.decode().split("\f")[:-1], "*.txt", **how)


def _folder(path: str):
    return F.regexp_extract(path, r"(source=[^/]*/bucket=[^/]*)", 1).alias("folder")


@query("src1_files", f"SELECT 'source=' || source || '/bucket=' || ({_BUCKET}) AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length FROM documents GROUP BY 1")
def _(x):
    found = readers.files(x.spark, _archive(x), "*.txt")
    return found.select(F.regexp_replace("relative_path", r"/[^/]*\z", "").alias("folder"), "length")


_CLEAN = f"SELECT 'source=' || source || '/bucket=' || ({_BUCKET}) AS folder, doc_id, {clean_page_sql("coalesce(text, '')")} AS t FROM documents"


@query("src2_pages", f"SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY doc_id)::INTEGER AS page_no, md5(t) AS h FROM ({_CLEAN}) WHERE t <> ''")
def _(x):
    return _pages(x).select(_folder("path"), "page_no", fingerprint(F.col("text")).alias("h"))


class _FormFeeds:
    """Opens files whose pages end at form feeds."""

    def _texts(self, path: str) -> list[str]:
        with pa.fs.LocalFileSystem().open_input_stream(path) as f:
            return f.read().decode().split("\f")[:-1]

    def count(self, path: str) -> int:
        return len(self._texts(path))

    def read(self, path: str, first: int, last: int) -> list[str]:
        return self._texts(path)[first:last]


@query("src2_page_ranges", f"SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY doc_id)::INTEGER AS page_no, md5(t) AS h FROM ({_CLEAN}) WHERE t <> ''")
def _(x):
    """By stretches of 50 pages, each a task."""
    rows = pages.cleaned(pages.page_rows(x.spark, _archive(x), _FormFeeds(), "*.txt", task_pages=50))
    return rows.select(_folder("path"), "page_no", fingerprint(F.col("text")).alias("h"))


_STRIPPED = strip_sql("text")


@query("src3_recognised_pages", rf"""
SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY doc_id)::INTEGER AS page_no, CASE WHEN bad THEN said ELSE md5(t) END AS h FROM (
  SELECT *, 'page ' || (row_number() OVER (PARTITION BY folder ORDER BY doc_id) - 1) || ' again' AS said FROM (
    SELECT c.*, length({_STRIPPED}) < 50 OR length(regexp_replace({_STRIPPED}, '[\x20-\x7E\s\x{{0900}}-\x{{097F}}]', '', 'g'))::DOUBLE / length({_STRIPPED}) > 0.1 AS bad
    FROM ({_CLEAN}) c JOIN documents USING (doc_id)))
WHERE bad OR t <> ''""")
def _(x):
    """Pages of garbage are read by other means, here by saying their place in the file."""
    y = _pages(x, recognise=lambda data, place: f"page {place} again")
    said = F.col("text").rlike(r"\Apage \d+ again\z")
    return y.select(_folder("path"), "page_no", F.when(said, F.col("text")).otherwise(fingerprint(F.col("text"))).alias("h"))


_FULL = f"SELECT folder, count(*) AS total_pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY doc_id)) AS h FROM ({_CLEAN}) WHERE t <> '' GROUP BY folder"


@query("src4_full_texts", _FULL)
def _(x):
    return readers.full_texts(_pages(x)).select(_folder("path"), "total_pages", fingerprint(F.col("full_text")).alias("h"))


@query("snk3_raw_text", _FULL)
def _(x):
    path = scratch(x.spark, "raw")
    writers.raw_text(_pages(x), path)
    back = x.spark.read.schema("source_pdf string, full_text string, pages map<string,string>").json(path)
    return back.select(_folder("source_pdf"), F.size("pages").cast("bigint").alias("total_pages"), fingerprint(F.col("full_text")).alias("h"))


@query("src5_master_index", f"SELECT 'd' || doc_id AS document_id, source AS store_path, {words('text')} AS total_words FROM documents")
def _(x):
    path = scratch(x.spark, "master")
    x.documents.select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("source").alias("store_path"), word_count("text").alias("total_words")).write.json(path)
    return readers.master_index(x.spark, path, lines=True).select("document_id", "store_path", "total_words")


@query("src5_one_map", "SELECT 'd' || doc_id AS document_id, source AS store_path, coalesce(left(text, 400), '') AS unit_title FROM documents")
def _(x):
    """One map in parts, whose strings hold quotes, braces and commas as the texts do. Rows end with the brace that ends their line."""
    path = scratch(x.spark, "map")
    entry = F.concat(F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("k"))).substr(F.lit(6), F.length(F.concat(F.lit("d"), "doc_id")) + 2), F.lit(": "),
                     F.to_json(F.struct(F.col("source").alias("store_path"), F.coalesce(F.left("text", F.lit(400)), F.lit("")).alias("unit_title"))))
    first, head, tail = x.documents.agg(F.min("doc_id").alias("first")), '{"made": {"by": "a, {b"}, "documents": {', '}, "n": [1, {"d0": {}}]}'
    rows = x.documents.join(F.broadcast(first)).select(F.lit(1).alias("at"), "doc_id", F.concat(F.when(F.col("doc_id") == F.col("first"), head).otherwise(", "), entry).alias("value"))
    end = first.select(F.lit(2).alias("at"), F.lit(0).alias("doc_id"), F.concat(F.when(F.col("first").isNull(), head).otherwise(""), F.lit(tail)).alias("value"))
    rows.unionByName(end).orderBy("at", "doc_id").select(F.expr("left(value, length(value) - 1)").alias("value")).write.option("lineSep", "}").text(path)
    return readers.master_index(x.spark, path).select("document_id", "store_path", "unit_title")


@query("src9_citations", "SELECT source, md5(text) AS h FROM documents WHERE text <> ''")
def _(x):
    path = scratch(x.spark, "cites")
    cites = F.collect_list(F.struct(F.col("text").alias("citation_text")))
    _placed(x, "text").groupBy("source", "bucket").agg(F.to_json(F.struct(cites.alias("citations"))).alias("value")).write.partitionBy("source", "bucket").text(path)
    return readers.citations(x.spark, path).select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), fingerprint(F.col("citation_text")).alias("h"))


@query("src11_chapters", "SELECT DISTINCT source AS chapter FROM documents WHERE lang = 'en'")
def _(x):
    path = scratch(x.spark, "manifest")
    by_lang = x.documents.filter("lang IS NOT NULL").groupBy("lang").agg(F.create_map(F.lit("en"), F.collect_set("source")).alias("of"))
    by_lang.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "of")))).alias("value")).write.text(path)
    return readers.chapters(x.spark, path, "en", "en")


@query("snk1_replace_documents", "SELECT source AS document_id, doc_id, CASE WHEN source < 'src5' THEN 2 ELSE 1 END AS v FROM documents")
def _(x):
    """The documents of some sources are written again and replace their folders; the others stay."""
    path, rows = scratch(x.spark, "chunks"), x.documents.select(F.col("source").alias("document_id"), "doc_id")
    writers.replace_documents(rows.withColumn("v", F.lit(1)), path)
    writers.replace_documents(rows.filter("document_id < 'src5'").withColumn("v", F.lit(2)), path)
    return x.spark.read.schema("document_id string, doc_id bigint, v int").parquet(path).select("document_id", "doc_id", "v")


@query("snk2_master_index", "SELECT source AS document_id, arg_max(md5(text), doc_id) AS label FROM documents GROUP BY source")
def _(x):
    path = scratch(x.spark, "index")
    writers.master_index(x.documents.select(F.col("source").alias("document_id"), fingerprint(F.col("text")).alias("label"), "doc_id"), path, "doc_id")
    return x.spark.read.parquet(path)


@query("snk4_append_new", "SELECT source, doc_id, md5(text) AS h FROM documents")
def _(x):
    """Two runs over the same rows, of which the second adds nothing."""
    path, rows = scratch(x.spark, "appended"), x.documents.select("source", "doc_id", fingerprint(F.col("text")).alias("h"))
    for _ in range(2):
        writers.append_new(rows, path, ("source", "doc_id"))
    return x.spark.read.parquet(path)


@query("snk10_create", """
SELECT 's' || doc_id AS id, 'pending' AS status, (1 + doc_id % 5)::INTEGER AS total_requested, 0 AS total_generated, '{"subject":"' || source || '"}' AS parameters FROM documents""")
def _(x):
    """A table of sessions that is there is left as it is."""
    path, n = scratch(x.spark, "sessions"), F.col("doc_id")
    asked = x.documents.select(F.concat(F.lit("s"), n).alias("id"), F.lit("2024-01-01").alias("created_at"), (1 + n % 5).alias("total_requested"), F.struct(F.col("source").alias("subject")).alias("parameters"))
    writers.create(x.spark, path, store.SESSION)
    writers.append_new(store.new_session(asked), path, ("id",))
    writers.create(x.spark, path, store.SESSION)
    return x.spark.read.parquet(path).drop("created_at")
