"""Texts to hierarchical chunks: units, sections, levels, parents, and the clean-up after.

A text's headers are marked by one regular-expression pass that puts separators around them, and the
text is split there; what belongs to a document never leaves its partition before the first window.
All orders are total: (document, position).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import ColumnOrName, _c, let, sanitize, squeeze, strip, text, unit_id, word_count

# Headers of units and sections, what front matter says, and titles that say nothing.
_TITLE = r"(?:[ \t]+([^\n]{1,180})|[ \t]*\n[ \t]*([^\n]{1,180}))?"
UNIT = r"[ \t]*((?:unit|chapter)\s+\d+[a-zA-Z0-9-]*)" + _TITLE
SECTION = (
    r"[ \t]*((?:\d+\.\d+(?:\.\d+)*|(?:section|subsection|sub-section)\s+\d+(?:\.\d+)*|(?:example|figure|table)\s+\d+(?:\.\d+)?))"
    r"(?:[ \t]+([^\n]{1,180})|[ \t]*(?:\n[ \t]*)+((?!\d+(?:\.\d+)+\s*$)[^\n]{1,180}))?"
)
FRONT = r"(?iU)(all rights reserved|isbn|printed and published|section officer|school of humanities|laser typeset|copyright|block introduction)"
LOW_TITLE = r"(?i)\A(?:document root / introduction|structure|contents?)\z"
_BEFORE, _AFTER = "\x01", "\x02"


def _header(part: Column, pattern: str) -> tuple[Column, Column]:
    """Marker and title of a part that begins with a header."""
    at = r"(?iUmd)\A" + pattern
    inline, after = F.regexp_extract(part, at, 2), F.regexp_extract(part, at, 3) if re.compile(pattern).groups > 2 else F.lit("")
    return strip(F.regexp_extract(part, at, 1)), strip(F.when(inline != "", inline).otherwise(after))


def infer_level(marker: ColumnOrName) -> Column:
    """1 for units, chapters and sections, the depth of decimals (5 at most), 3 for examples, figures and tables, else 2."""
    m = F.lower(strip(_c(marker)))
    numbers = F.regexp_count(m, F.lit(r"\d+"))
    return (
        F.when(m.rlike(r"\A(?:chapter|unit|part|module|section)"), 1)
        .when(m.contains(".") & (numbers >= 2), F.least(numbers, F.lit(5)))
        .when(m.rlike(r"\A(?:example|figure|table)"), 3).otherwise(2).cast("int")
    )


def is_front_matter(body: ColumnOrName, title: ColumnOrName) -> Column:
    """Publication details in a short text, or a few words about structure."""
    head, n = F.concat(text(title), F.lit("\n"), F.left(text(body), F.lit(1000))), word_count(body)
    return (head.rlike(FRONT) & (n < 150)) | ((n < 12) & F.lower(head).contains("structure"))


def is_contents(marker: ColumnOrName, body: ColumnOrName, title: ColumnOrName) -> Column:
    """An entry of a table of contents rather than a section."""
    m, b, n = strip(F.lower(text(marker))), strip(body), word_count(body)
    lines = F.filter(F.transform(F.split(b, "\n"), lambda x: strip(x)), lambda x: x != "")
    numbers_only = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"(?U)\A\d+(?:\.\d+)+\z"))
    bare = (b == "") | numbers_only | ((n <= 8) & ~b.rlike("[a-zA-Z]{3,}"))
    return (F.lower(text(title)).contains("structure") & (n < 60)) | (m.rlike(r"(?U)\A\d+(?:\.\d+)+\z") & bare)


def split_units(docs: DataFrame, min_words: int = 80) -> DataFrame:
    """docs (document_id, full_text) to units: base_id, unit_idx, document_id, title, text.

    A unit runs from its header to the next; what stands before the first is lost, and so is a unit of
    fewer than min_words words. A document without units is one unit, its whole text.
    """
    marked = F.regexp_replace(sanitize("full_text"), r"(?iUmd)^" + UNIT, _BEFORE + "$0")
    parts = F.slice(F.split(marked, _BEFORE), 2, 1 << 30)

    def unit(part: Column) -> Column:
        marker, title = _header(part, UNIT)
        return F.struct(unit_id("document_id", marker).alias("document_id"), strip(F.concat_ws(" ", marker, title)).alias("title"), strip(part).alias("text"))

    units = F.filter(F.transform(parts, unit), lambda u: word_count(u["text"]) >= min_words)
    whole = F.array(F.struct("document_id", F.lit("Full Document").alias("title"), sanitize("full_text").alias("text")))
    x = docs.select(F.col("document_id").alias("base_id"), F.posexplode(let(units, lambda u: F.when(F.size(u) > 0, u).otherwise(whole))).alias("unit_idx", "u"))
    return x.select("base_id", "unit_idx", "u.*")


def _sections(body: ColumnOrName, header: str = SECTION) -> Column:
    """array of struct(marker, title, body) of the sections in a unit's text."""
    marked = F.regexp_replace(_c(body), r"(?iUmd)^" + header, _BEFORE + "$0" + _AFTER)

    def section(part: Column) -> Column:
        marker, title = _header(F.substring_index(part, _AFTER, 1), header)
        return F.struct(marker.alias("marker"), strip(F.concat_ws(" ", marker, title)).alias("title"), strip(F.substring_index(part, _AFTER, -1)).alias("body"))

    return F.transform(F.slice(F.split(marked, _BEFORE), 2, 1 << 30), section)


def _is_section() -> Column:
    return ~is_contents("marker", "body", "title") & ~is_front_matter("body", "title")


def split_sections(units: DataFrame, keys: tuple[str, ...] = ("base_id", "unit_idx"), header: str = SECTION) -> DataFrame:
    """units to the sections in them: the keys, pos, marker, title, body; contents and front matter are left out.

    header is the pattern of a section's header: the marker, the title behind it and, if there is a third group,
    the title on a line below. By the default any decimals that begin a line are one, an IP address as well; a
    corpus that knows its headers says so.
    """
    x = units.select(*keys, F.posexplode(_sections("text", header)).alias("pos", "s"))
    return x.select(*keys, "pos", "s.*").filter(_is_section())


def merge_titles(sections: DataFrame, keys: tuple[str, ...] = ("base_id", "unit_idx"), most: int = 800, least: int = 12, plain: Column | None = None) -> DataFrame:
    """Sections of one title as the first of them: its body up to most words, then the later bodies of least words or more.

    Rows for which plain holds are left as they are; their text is their body.
    """
    plain = F.lit(False) if plain is None else plain
    x = sections.withColumn("same", F.when(plain, F.concat(F.lit(_BEFORE), F.col("pos").cast("string"))).otherwise(strip(squeeze(F.lower("title")))))
    rest = [c for c in x.columns if c not in (*keys, "same")]
    long = F.when(word_count("body") >= least, F.struct("pos", "body"))
    x = x.groupBy(*keys, "same").agg(F.min_by(F.struct(*rest), "pos").alias("head"), F.collect_list(long).alias("later")).select(*keys, "head.*", "later")
    x = x.withColumn("later", F.array_sort(F.filter("later", lambda s: s["pos"] > F.col("pos"))))
    cut = let(F.filter(F.split("body", r"(?U)\s+"), lambda w: w != ""), lambda w: F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.col("body")))
    first = strip(F.concat(F.col("title"), F.lit("\n\n"), F.when(F.length("body") > 2 * most - 1, cut).otherwise(F.col("body"))))
    whole = F.when(F.size("later") == 0, first).otherwise(strip(F.array_join(F.concat(F.array(first), F.transform("later", lambda s: s["body"])), "\n\n")))
    return x.withColumn("text", F.when(plain, F.col("body")).otherwise(whole)).drop("later", "body")


def with_parents(sections: DataFrame, keys: tuple[str, ...], id_col: str, none: Column) -> DataFrame:
    """sections with parent_id: the last one before of a smaller level, or none; levels are 2 to 5."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = none
    for level in range(2, 6):
        last = F.last(F.when(F.col("level") < level, F.col(id_col)), ignorenulls=True).over(before)
        parent = F.when(F.col("level") == level, F.coalesce(last, none)).otherwise(parent)
    return sections.withColumn("parent_id", parent)


def chunk(docs: DataFrame, most: int = 800, header: str = SECTION) -> DataFrame:
    """docs (document_id, full_text) to chunks: chunk_id, document_id, pos, text, title, level, parent_id, word_count.

    A root, and for each unit that is no front matter its first 1200 characters and its sections. Units
    and sections go through the windows together, so that a text is parsed once. header is as in split_sections.
    """
    units = split_units(docs).filter(~is_front_matter(F.left("text", F.lit(1500)), "title"))
    title = F.when(F.col("title") == "", F.concat(F.lit("Unit "), (F.col("unit_idx") + 1).cast("string"))).otherwise(F.col("title"))
    head = F.struct(F.lit("").alias("marker"), title.alias("title"), F.left("text", F.lit(1200)).alias("body"))
    x = units.select("base_id", "unit_idx", F.posexplode(F.concat(F.array(head), _sections("text", header))).alias("pos", "s")).select("base_id", "unit_idx", "pos", "s.*")
    is_head = F.col("pos") == 0
    x = merge_titles(x.filter(is_head | _is_section()), most=most, plain=is_head)
    unit = F.concat(F.col("base_id"), F.lit("_unit_"), F.col("unit_idx").cast("string"))
    order = Window.partitionBy("base_id").orderBy("unit_idx", "pos")
    nth = F.sum((~is_head).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = x.withColumns({
        "chunk_id": F.when(is_head, unit).otherwise(F.concat(F.col("base_id"), F.lit("_sec_"), nth.cast("string"))),
        "level": F.when(is_head, 1).otherwise(F.greatest(F.lit(2), infer_level("marker"))), "nth": F.row_number().over(order),
    })
    x = with_parents(x, ("base_id", "unit_idx"), "chunk_id", unit)
    x = x.withColumn("parent_id", F.when(is_head, F.concat(F.col("base_id"), F.lit("_root"))).otherwise(F.col("parent_id")))
    rest = x.select("chunk_id", F.col("base_id").alias("document_id"), F.col("nth").alias("pos"), "text", "title", "level", "parent_id")
    roots = docs.select(F.concat(F.col("document_id"), F.lit("_root")).alias("chunk_id"), "document_id", F.lit(0).alias("pos"), F.lit("").alias("text"), F.lit("Document Root / Introduction").alias("title"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"))
    return roots.unionByName(rest).withColumn("word_count", word_count("text"))


# After chunking -------------------------------------------------------------------------------


def is_low_value(body: ColumnOrName, title: ColumnOrName, least: int = 12) -> Column:
    """Too few words, a boilerplate title, or nothing but numbers."""
    return (word_count(body) < least) | strip(title).rlike(LOW_TITLE) | text(body).rlike(r"(?U)\A\s*[\d\s.]+\s*\z")


def drop_repeats(chunks: DataFrame) -> DataFrame:
    """Of chunks of a document with one title and one beginning, the first."""
    key = [strip(squeeze(F.lower(strip("title")))), squeeze(F.left(F.lower(strip("text")), F.lit(400)))]
    first = F.row_number().over(Window.partitionBy("document_id", *key).orderBy("pos"))
    return chunks.withColumn("nth", first).filter("nth = 1").drop("nth")


def fold_low_value(chunks: DataFrame, least: int = 12) -> DataFrame:
    """Chunks of low value go into the kept one before if they share its parent or level, else they vanish; the first is kept."""
    by = Window.partitionBy("document_id").orderBy("pos")
    x = chunks.withColumn("keep", ~is_low_value("text", "title", least) | (F.row_number().over(by) == 1))
    x = x.withColumn("island", F.sum(F.col("keep").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    body = strip("text")
    low = F.collect_list(F.when(~F.col("keep") & (body != ""), F.struct("pos", body.alias("t"), F.col("parent_id").alias("p"), F.col("level").alias("l"))))
    x = x.groupBy("document_id", "island").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "document_id"]), "pos").alias("head"), low.alias("more")).select("document_id", "head.*", "more")
    x = x.withColumn("more", F.array_sort(F.filter("more", lambda s: s["p"].eqNullSafe(F.col("parent_id")) | F.coalesce(s["l"] == F.col("level"), F.lit(False)))))
    joined = F.when(F.size("more") == 0, F.col("text")).otherwise(strip(F.array_join(F.concat(F.array("text"), F.transform("more", lambda s: s["t"])), "\n\n")))
    x = x.withColumn("text", joined)
    return x.withColumn("word_count", word_count("text")).drop("more")


def repair_parents(chunks: DataFrame, nearest: bool = False) -> DataFrame:
    """Parents that are not there become the last chunk of the document with a smaller level, or the first chunk.

    With nearest, the last such chunk before it.
    """
    whole = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1 if nearest else Window.unboundedFollowing)
    ids = chunks.select(F.col("document_id").alias("d"), F.col("chunk_id").alias("c"))
    x = chunks.join(ids, (F.col("document_id") == F.col("d")) & (F.col("parent_id") == F.col("c")), "left")
    first = F.first("chunk_id").over(Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("f", first)
    other = F.col("f")
    for level in range(2, 6):
        found = F.last(F.when(F.col("level") < level, F.col("chunk_id")), ignorenulls=True).over(whole)
        other = F.when(F.col("level") == level, F.coalesce(found, F.col("f"))).otherwise(other)
    dangling = F.col("parent_id").isNotNull() & F.col("c").isNull()
    return x.withColumn("parent_id", F.when(dangling, other).otherwise(F.col("parent_id"))).drop("d", "c", "f")


def with_children(chunks: DataFrame) -> DataFrame:
    """chunks with children_ids, in order of position."""
    kids = chunks.filter("parent_id IS NOT NULL").groupBy(F.col("document_id").alias("d"), F.col("parent_id").alias("p")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]).alias("children_ids"))
    x = chunks.join(kids, (F.col("document_id") == F.col("d")) & (F.col("chunk_id") == F.col("p")), "left").drop("d", "p")
    return x.withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def post_process(chunks: DataFrame, least: int = 12) -> DataFrame:
    return with_children(repair_parents(fold_low_value(drop_repeats(chunks), least)))
