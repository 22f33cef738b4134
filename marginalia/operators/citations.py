"""Citations: mining of pages, two special extractors, choice of one."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import citation_markers, is_citation_page, locator, strip, strip_citations, word_count
from marginalia.operators.containment import containing


def citation_pages(pages: DataFrame) -> DataFrame:
    """pages (block_name, unit_name, source_pdf, page_no, text) to those with 1 to 15 valid markers."""
    x = pages.withColumn("matched_markers", citation_markers("text")).filter(is_citation_page(F.col("matched_markers")))
    return x.select("block_name", "unit_name", "source_pdf", F.col("page_no").cast("string").alias("pdf_page"), F.size("matched_markers").alias("citations_count"), "matched_markers", strip("text").alias("citation_text"))


def pick(citations: DataFrame, by: tuple[str, ...], seed: str = "") -> DataFrame:
    """One citation of each group: that of least hash with the seed. Has page (its locator), cleaned text and word_count.

    citations has citation_text, or text, quote or citation in its place; the first that is not empty counts.
    """
    x = _first(citations.withColumn("original", _original(citations)), by, seed)
    return _cleaned(x, by)


def _original(citations: DataFrame) -> Column:
    names = [c for c in ("citation_text", "text", "quote", "citation") if c in citations.columns]
    return strip(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit("")))


def _first(x: DataFrame, by: tuple[str, ...], seed: str) -> DataFrame:
    """by and original, that of least hash with the seed; combined before the shuffle, so groups may be of any size."""
    least = F.min(F.struct(F.md5(F.concat(F.lit(seed), F.col("original"))).alias("hash"), "original"))
    return x.groupBy(*by).agg(least.alias("first")).select(*by, F.col("first.original").alias("original"))


def _cleaned(x: DataFrame, by: tuple[str, ...]) -> DataFrame:
    cleaned = strip_citations("original")
    return x.select(*by, cleaned.alias("citation"), locator("original").alias("page"), word_count(cleaned).alias("word_count"), F.col("original").alias("citation_original"))


def of_documents(citations: DataFrame, documents: DataFrame, requests: DataFrame, seed: str = "") -> DataFrame:
    """One citation for each request (request_id, subject) from the documents (document_id, subject) whose subject holds its own.

    citations has document_id. What is asked for otherwise does not steer the choice, so it is made once a
    subject: of a document's citations, then of those of documents of one subject, then of the subjects that
    hold the one asked for, which an index of trigrams finds.
    """
    own = documents.select("document_id", F.lower("subject").alias("said"))
    best = _first(_first(citations.withColumn("original", _original(citations)), ("document_id",), seed).join(own, "document_id"), ("said",), seed)
    asked = requests.select("request_id", F.lower("subject").alias("asked"))
    chosen = _first(containing(own, asked).join(best, "said"), ("asked",), seed)
    return _cleaned(asked.join(chosen, "asked"), ("request_id",))


def of_documents_dual(citations: DataFrame, documents: DataFrame, requests: DataFrame, seed: str = "") -> DataFrame:
    """request_id, topic_citation, theme_citation: two choices for each request."""
    a, b = (of_documents(citations, documents, requests, f"{seed}{k}").select("request_id", F.col("citation").alias(f"{k}_citation")) for k in ("topic", "theme"))
    return a.join(b, "request_id")


# Special extractors ----------------------------------------------------------------------------

# What begins and what ends a speech or a verse, and the words that one has at most.
SPEAKER = r"(?i)(?:\A|\n+)((?:Chorus|Creon)[ \t]*|[a-zA-Z]+(?:[ \t]+[a-zA-Z]+)?[ \t]+):"
SPEECH_END = r"(?i)\b(?:analysis|summary)\b|\b\d+\.\d+"
VERSE = r"(?i)(?:\A|\n+)([a-zA-Z]+:[ \t]*\n+|\d+(?:\.\d+)+[ \t]*\n+[ \t]*text[ \t]*\n+(?!\d+(?:\.\d+)+))"
VERSE_END = r"(?i)\bglossary\b"
SECTION = r"\d+(?:\.\d+)+"
MOST_WORDS = 210

Start = tuple[int, str, int]  # where a piece may begin, its marker, and where an end mark may be first


def covered(body: str, starts: Iterable[Start], ends: list[int], most: int, always: bool) -> Iterator[tuple[str, str]]:
    """Marker and text of the pieces that are taken from left to right, each from a start that no piece before it covers.

    A piece goes to the next end mark, or to the end of the text; where it then has more than most words, these are
    all of it: always, or only where no mark ends it. The end marks are looked up in their sorted places and a
    text is cut for pieces that are taken only, so the time is linear in the text, whatever its number of starts.
    """
    words, word, free = re.compile(rf"\s*(?:\S+\s+){{0,{most - 1}}}\S+"), re.compile(r"\S"), 0
    for at, marker, after in starts:
        if at < free:
            continue
        k = bisect.bisect_left(ends, after)
        free = ends[k] if k < len(ends) else len(body)
        if always or k == len(ends):
            head = words.match(body, at, free)
            if head and word.search(body, head.end(), free):
                free = head.end()
        yield marker, body[at:free].strip()


def _pieces(docs: DataFrame, found: Callable[[str], Iterator[tuple[str, str]]]) -> DataFrame:
    """A row for each piece that found, from a text to markers and texts, gives for a document; empty ones are left out."""
    schema = "block_name string, source_pdf string, marker string, citation_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                got = [x for x in found(batch.column("full_text")[k].as_py() or "") if x[1]]
                own = [pa.array([batch.column(c)[k].as_py()] * len(got), pa.string()) for c in ("block_name", "source_pdf")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[i] for x in got], pa.string()) for i in (0, 1))], names=["block_name", "source_pdf", "marker", "citation_text"])

    x = docs.select(*[F.col(c).cast("string").alias(c) for c in ("block_name", "source_pdf", "full_text")]).mapInArrow(run, schema)
    return x.select("block_name", F.lit("Unknown/Full Document").alias("unit_name"), "source_pdf", F.lit("Full Text").alias("pdf_page"), F.lit(1).alias("citations_count"), F.array("marker").alias("matched_markers"), "citation_text")


def speeches(body: str, most: int = MOST_WORDS) -> Iterator[tuple[str, str]]:
    marks = [(m.start(), m[1].strip()) for m in re.finditer(SPEAKER, body)]
    starts = ((at, f"{who}:", at) for at, who in marks if who.lower() != "analysis")
    return covered(body, starts, [m.start() for m in re.finditer(SPEECH_END, body)], most, always=True)


def stanzas(body: str, most: int = MOST_WORDS) -> Iterator[tuple[str, str]]:
    starts = []
    for m in re.finditer(VERSE, body):
        marker = " ".join(m[1].split())
        starts.append((m.start(), marker, m.start(1) + len(marker)))
    for marker, piece in covered(body, starts, [m.start() for m in re.finditer(VERSE_END, body)], most, always=False):
        if re.match(SECTION, marker) or not re.search(SECTION, piece[:50]):
            yield marker, piece


def dialogues(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """docs (block_name, source_pdf, full_text) to speeches: from a speaker's line to analysis, a summary, a section number or most words.

    Speakers inside a speech that was taken do not begin one; a speaker called analysis never does. Null and empty
    texts have none.
    """
    return _pieces(docs, lambda body: speeches(body, most))


def verses(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """docs to verses: from a header to the glossary, or most words. One with a section number near its start is dropped, unless it begins with one."""
    return _pieces(docs, lambda body: stanzas(body, most))
