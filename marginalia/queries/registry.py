"""The registry of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory by name, and the roles that they play."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self, *more: Column) -> DataFrame:
        """Vectors with the text of the document of their number; labels play documents. more of documents is worked out before they are joined."""
        d = self.documents.select(F.col("doc_id").alias("vec_id"), "text", "source", *more)
        return self.embeddings.join(d, "vec_id").select(
            F.col("label").alias("document_id"), F.col("vec_id").alias("pos"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("source").alias("title"), "text", "embedding", *[c for c in d.columns if c not in ("vec_id", "text", "source")])

    def vectors(self) -> DataFrame:
        """The same without texts, which texts() has by pos."""
        n = F.col("vec_id")
        return self.embeddings.select(F.col("label").alias("document_id"), n.alias("pos"), F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"), "embedding")

    def texts(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("pos"), F.col("source").alias("title"), "text")

    def asked(self) -> DataFrame:
        """The stated set of queries, which grows with the table."""
        return self.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def marked(self) -> DataFrame:
        """Documents whose lines got headers of units and sections."""
        line = lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("Unit "), (F.floor(i / 12) + 1).cast("string"), F.lit(" Part\n"), x)).when(
            i % 3 == 1, F.concat(F.lit("1."), (i % 12).cast("string"), F.when(i % 2 == 0, ".2").otherwise(""), F.lit(" Topic "), (i % 5).cast("string"), F.lit("\n"), x)).otherwise(x)
        return self.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("full_text"))

    def tree(self) -> DataFrame:
        """Chunks of a tree: every line of a document under one of the lines before."""
        x = self.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        c = lambda p: F.concat(F.col("document_id"), F.lit("_"), p.cast("string"))
        up = F.when(F.col("pos") % 7 == 5, F.lit("gone")).otherwise(c(F.floor((F.col("pos") - 1) / 3)))
        level = F.when(F.col("pos") == 0, 1).otherwise(2 + F.col("pos") % 3)
        return x.select("document_id", "pos", c(F.col("pos")).alias("chunk_id"), F.concat(F.lit("t"), (F.col("pos") % 4).cast("string")).alias("title"), "text", level.cast("int").alias("level"), F.when(F.col("pos") > 0, up).alias("parent_id"))


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with the SQL of the same rows if there is one."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


def fingerprint(c: Column) -> Column:
    """A text's MD5, so that results stay small."""
    return F.md5(c)


#: Pieces of SQL.
CHUNKS = """chunks AS (
  SELECT e.label AS document_id, e.vec_id AS pos, 'c' || e.vec_id AS chunk_id, d.source AS title, d.text, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.* EXCLUDE (embedding),
         round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
         / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 12) AS sim
  FROM embeddings q JOIN chunks c ON q.vec_id % 50 = 0)"""
MARKED = r"""marked AS (
  SELECT 'd' || doc_id AS document_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j:
    CASE WHEN (j - 1) % 12 = 0 THEN 'Unit ' || ((j - 1) // 12 + 1) || ' Part' || chr(10) || x
         WHEN (j - 1) % 3 = 1 THEN '1.' || ((j - 1) % 12) || CASE WHEN (j - 1) % 2 = 0 THEN '.2' ELSE '' END || ' Topic ' || ((j - 1) % 5) || chr(10) || x ELSE x END), chr(10)) AS full_text
  FROM documents)"""
TREE = """tree AS (
  SELECT document_id, pos, document_id || '_' || pos AS chunk_id, 't' || (pos % 4) AS title, text, (CASE WHEN pos = 0 THEN 1 ELSE 2 + pos % 3 END)::INTEGER AS level,
         CASE WHEN pos > 0 THEN CASE WHEN pos % 7 = 5 THEN 'gone' ELSE document_id || '_' || ((pos - 1) // 3) END END AS parent_id
  FROM (SELECT 'd' || doc_id AS document_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"""


def words(x: str) -> str:
    return rf"len(regexp_extract_all(coalesce({x}, ''), '\S+'))::INTEGER"


def strip_sql(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def sanitize_sql(x: str) -> str:
    t = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{FFFD}}]', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\r\n?', chr(10), 'g'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g')"
    return strip_sql(rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def clean_page_sql(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({x}, '(?m)^\s*\d+\s*$', '', 'g'), '\.{{10,}}', '', 'g')"
    t = rf"regexp_replace({t}, '(?im)^\s*(Reprint\s*\d{{4}}-\d{{2}}|not to be republished)\s*$', '', 'g')"
    return strip_sql(rf"regexp_replace({t}, '(?m)^\s*([A-Z][a-zA-Z\s&]+){{3,}}\s*$', '', 'g')")
