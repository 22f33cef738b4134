"""Text functions of columns. Null is the empty text unless a function says otherwise.

Patterns are Java's with (?U), so that white space and word characters are Unicode's, and (?d), so
that only a newline ends a line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x), F.lit(""))


#: White space as Unicode and Python have it; fixed values.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def word_count(x: ColumnOrName) -> Column:
    """Tokens between white space."""
    return F.regexp_count(text(x), F.lit(r"(?U)\S+")).cast("int")


def strip(x: ColumnOrName) -> Column:
    """Without white space at both ends."""
    return F.btrim(text(x), F.lit(WHITE))


def squeeze(x: ColumnOrName) -> Column:
    """Runs of white space as one space. A single space is not matched, as it stays what it is."""
    return F.regexp_replace(text(x), r"(?U)\s\s+|[^\S ]", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(x: ColumnOrName) -> Column:
    return F.nullif(_c(x), F.lit(""))


def contains_ci(x: ColumnOrName, part: str) -> Column:
    """Whether the text holds the part, whatever the case; null for null."""
    return F.lower(_c(x)).contains(part.lower())


# Cleaning --------------------------------------------------------------------------------------


def sanitize(x: ColumnOrName) -> Column:
    """Control characters as spaces, Unix line ends, no zero-width characters, single blanks, at most one empty line in a row."""
    t = F.regexp_replace(text(x), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\uFFFD]", " ")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = _where(t, ("\u200b", "\u200c", "\u200d", "\ufeff"), "[\\u200b\\u200c\\u200d\\ufeff]", "")
    t = _where(t, ("  ", "\t"), "[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def _where(t: Column, signs: tuple[str, ...], pattern: str, to: str) -> Column:
    """The pattern replaced in texts that hold one of the signs, which is quick to see; others have no match."""

    def replaced(v: Column) -> Column:
        some = F.lit(False)
        for c in signs:
            some = some | v.contains(c)
        return F.when(some, F.regexp_replace(v, pattern, to)).otherwise(v)

    return let(t, replaced)


#: A line, or lines, of letters, blanks and & that hold three capitals with something after each. The language is a fixed value; the
#: repeated group `([A-Z][a-zA-Z\s&]+){3,}` is written out so that each character can be matched in one way only, as Java's backtracking has no end else.
HEADLINE = r"(?Umd)^\s*[A-Z][a-zA-Z\s&][a-z\s&]*[A-Z][a-zA-Z\s&][a-z\s&]*[A-Z][a-zA-Z\s&]+$"


# Page numbers, dot leaders and notices that pages carry.
PAGE_NUMBER, LEADERS = r"(?Umd)^\s*\d+\s*$", r"\.{10,}"
NOTICE = r"(?iUmd)^\s*(Reprint\s*\d{4}-\d{2}|not to be republished)\s*$"


def clean_page(x: ColumnOrName) -> Column:
    """A page's text without page numbers, dot leaders, reprint notices and running heads."""
    t = text(x)
    for pattern in (PAGE_NUMBER, LEADERS, NOTICE, HEADLINE):
        t = F.regexp_replace(t, pattern, "")
    return strip(t)


#: Characters of a page whose font was read rightly: printable ASCII, white space, Devanagari.
SOUND = r"[\x20-\x7E\s\u0900-\u097F]"


def odd_share(x: ColumnOrName) -> Column:
    """Share of characters outside printable ASCII, white space and Devanagari; null for the empty text."""
    t = text(x)
    odd = F.length(F.regexp_replace(t, "(?U)" + SOUND, ""))
    return odd / F.nullif(F.length(t), F.lit(0))


def is_garbage(x: ColumnOrName, threshold: float = 0.10, least: int = 50) -> Column:
    """Too short, or of a broken font."""
    return (F.length(text(x)) < least) | F.coalesce(odd_share(x) > threshold, F.lit(True))


def garbage(t: str, threshold: float = 0.10, least: int = 50) -> bool:
    """What is_garbage says, of a text that is no column."""
    return len(t) < least or len(re.sub(SOUND, "", t)) / len(t) > threshold


# Languages -------------------------------------------------------------------------------------

_DEVANAGARI, _LATIN = "[\\u0900-\\u097F]", "[A-Za-z]"


def language(x: ColumnOrName) -> Column:
    """hi if any Devanagari, else en if any Latin letter, else unknown."""
    t = text(x)
    return F.when(t.rlike(_DEVANAGARI), "hi").when(t.rlike(_LATIN), "en").otherwise("unknown")


def language_mixed(x: ColumnOrName) -> Column:
    """As language, but hien if both are there."""
    t = text(x)
    return F.when(t.rlike(_DEVANAGARI) & t.rlike(_LATIN), "hien").otherwise(language(x))


# Labels and ids --------------------------------------------------------------------------------


def path_parts(path: ColumnOrName) -> Column:
    """Segments of a path, without empty ones and the archive's own folder."""
    parts = F.split(F.translate(text(path), "\\", "/"), "/")
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "egyankosh"))


def subject_and_block(path: ColumnOrName) -> Column:
    """struct(subject, block): the first segment with the word block, and the one before it.

    A segment before it that names a store is no subject; without one, the last but one segment is.
    """
    parts = path_parts(path)
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"(?iU)\bblock\b")), True)
    block = F.when(at > 0, F.get(parts, (at - 1).cast("int")))
    before = F.when(at > 1, F.get(parts, (at - 2).cast("int")))
    before = F.when(~F.lower(before).startswith("rag_store"), before)
    last_but_one = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    return F.struct(F.coalesce(before, last_but_one).alias("subject"), block.alias("block"))


def block_in_text(x: ColumnOrName) -> Column:
    """`Block <name>` of up to seven tokens after the word block, cut at a structural word; null if it is only a stop word."""
    found = F.regexp_extract(strip(squeeze(x)), r"(?i)\bblock\b[\s:\-]*([a-z0-9]+(?:[\s\-]+[a-z0-9]+){0,6})\b", 1)
    label = strip(F.get(F.split(found, r"(?i)\b(?:unit|chapter|structure|objectives|introduction)\b"), F.lit(0)))
    stop = F.lower(F.get(F.split(label, " "), F.lit(0))).isin("here", "there", "this", "that", "the", "a", "an", "of", "for", "to", "in")
    return F.when((label != "") & ~stop, F.concat(F.lit("Block "), label))


#: A block's name in capitals up to the next heading. A fixed value.
_BLOCK = r"(?U)\bBLOCK\s*([\w\s:,-]{1,100}?)(?=\b(?:UNIT|CHAPTER|STRUCTURE|OBJECTIVES|INTRODUCTION|P\d)\b|$)"


def safe_segment(x: ColumnOrName, most: int = 120) -> Column:
    """A name for a folder or file."""
    t = strip(squeeze(F.translate(text(x), '<>:"/\\|?*', " " * 9)))
    return F.coalesce(blank_to_null(F.left(t, F.lit(most))), F.lit("UNSPECIFIED"))


def block_label(stem: ColumnOrName, full_text: ColumnOrName) -> Column:
    """`BLOCK <NAME>` from a file's stem or the first 6000 characters of its text, whichever is longer."""
    name = strip(squeeze(F.upper(F.regexp_replace(text(stem), r"[_\-]+", " "))))
    head = F.upper(squeeze(F.left(text(full_text), F.lit(6000))))
    of_name, of_text = (strip(F.regexp_extract(t, _BLOCK, 1)) for t in (name, head))
    best = F.when(F.length(of_text) > F.length(of_name), of_text).otherwise(of_name)
    number = F.regexp_extract(name, r"(?U)\bBLOCK\s*(\d+|[IVX]+)\b", 1)
    best = F.when((best == "INTRODUCTION") & (number != ""), number).otherwise(best)
    return F.when(best == "", "BLOCK UNSPECIFIED").otherwise(F.concat(F.lit("BLOCK "), safe_segment(best)))


def block_number(file_name: ColumnOrName) -> Column:
    """`Block n` of a file name, n without leading zeros, or the name's stem."""
    stem = F.regexp_replace(F.regexp_extract(text(file_name), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    n = F.regexp_extract(stem, r"(?iU)block\s*(\d+)", 1).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("Block "), n.cast("string")), stem)


def document_id(path: ColumnOrName, stem: ColumnOrName) -> Column:
    """`Unit-<stem without its block>_<8 hex digits of the path's MD5>`."""
    base = F.replace(strip(squeeze(F.regexp_replace(text(stem), r"(?iU)\bblock\s*[A-Za-z0-9-]+", ""))), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("Unit-"), safe_segment(base), F.lit("_"), F.left(F.md5(text(path)), F.lit(8)))


def unit_id(base: ColumnOrName, marker: ColumnOrName) -> Column:
    return F.concat(_c(base), F.lit("_"), F.regexp_replace(F.upper(text(marker)), r"(?U)\s+", "_"))


def search_text(*parts: ColumnOrName) -> Column:
    return F.lower(F.concat_ws(" ", *[text(p) for p in parts]))


def embedding_input(title: ColumnOrName, body: ColumnOrName, most: int = 1000) -> Column:
    return F.concat(text(title), F.lit(": "), F.left(text(body), F.lit(most)))


def unsafe_path(path: ColumnOrName) -> Column:
    """Whether a path climbs or is absolute, and so must not be served."""
    return text(path).contains("..") | text(path).startswith("/")


# Citations -------------------------------------------------------------------------------------

# What counts as a citation's marker, as a reference, and as a locator.
#: A parenthesis at a line's start that holds a letter and ends in digits, or one of digits anywhere.
MARKER = r"(?iU)(?:\A|\n)\s*(\(\s*[^)]*[a-z][^)]*\d[\d\s\-,]*\s*\))|(\(\s*(?:p\.?|pp\.?)?\s*[\d\s\-,]+\s*\))"


#: Parentheses that give a page or a place in a work, and those that hold only a number.
REFERENCE = r"(?iU)\s*\((?:[^)]*\b(?:p\.?|pp\.?|page|pg|Prologue|Chapter|Canto|Book)\b[^)]*)\)"
NUMBER_ONLY = r"(?U)\s*\(\s*\d{1,4}\s*\)"
#: What a parenthesis says of page or place, and a number after `p.`.
PLACE = r"(?iU)\(([^)]*(?:\b(?:p\.?|pp\.?|page|pg|canto|book|prologue)\b)[^)]*)\)"
PAGE = r"(?U)\b[pP]\.\s*(\d{1,4})\b"


def citation_markers(x: ColumnOrName, longest: int = 50) -> Column:
    """Citation markers of a page: short, not about a reprint, not a bare year."""
    raw = F.transform(F.regexp_extract_all(text(x), F.lit(MARKER), F.lit(0)), lambda m: strip(m))
    inside = lambda m: F.regexp_replace(m, r"\A[() \t\n\r]+|[() \t\n\r]+\z", "")
    return F.filter(raw, lambda m: (F.length(m) <= longest) & ~F.lower(m).contains("reprinted") & ~inside(m).rlike(r"(?U)\A(?:19|20)\d{2}\z"))


def is_citation_page(markers: Column, most: int = 15) -> Column:
    return F.size(markers).between(1, most)


def strip_citations(x: ColumnOrName) -> Column:
    """Without parentheses that give a page or a place in a work, or that hold only a number."""
    return strip(F.regexp_replace(F.regexp_replace(text(x), REFERENCE, ""), NUMBER_ONLY, ""))


def locator(x: ColumnOrName) -> Column:
    """What a parenthesis says of page or place, else the number after `p.`; null if neither is there."""
    inside, number = F.regexp_extract(text(x), PLACE, 1), F.regexp_extract(text(x), PAGE, 1)
    return F.when(inside != "", strip(inside)).otherwise(blank_to_null(number))


def first_words(x: ColumnOrName, most: int = 210) -> Column:
    """struct(text, end): the first words with the blanks between them, and where they end."""
    head = F.regexp_extract(text(x), rf"(?U)\A\s*(?:\S+\s+){{0,{most - 1}}}\S+", 0)
    return F.struct(strip(head).alias("text"), F.length(head).alias("end"))


def split_citation(x: ColumnOrName) -> Column:
    """struct(answer, citation): what a line that begins with `Citation:` says up to the end, and the rest."""
    pattern = r"(?ismd)^Citation:\s*(.*)"
    t = text(x)
    has = t.rlike(pattern)
    answer = F.when(has, strip(F.regexp_replace(t, pattern, ""))).otherwise(_c(x))
    return F.struct(answer.alias("answer"), F.when(has, blank_to_null(strip(F.regexp_extract(t, pattern, 1)))).alias("citation"))


# Model output ----------------------------------------------------------------------------------


def strip_fences(x: ColumnOrName) -> Column:
    """Without the code fence around it, if it begins with one."""
    t = strip(x)
    bare = F.regexp_replace(F.regexp_replace(t, r"(?iU)\A```(?:json)?\s*", ""), r"(?U)\s*```\z", "")
    return F.when(t.startswith("```"), bare).otherwise(t)


def strip_thinking(x: ColumnOrName) -> Column:
    return strip(F.regexp_replace(text(x), r"(?s)<think>.*?</think>", ""))


def option_markers(x: ColumnOrName) -> Column:
    """Those of A to D that begin a line as an option does."""
    found = [F.when(text(x).rlike(rf"(?iUmd)^\s*{m}\s*[).:\-]"), m) for m in "ABCD"]
    return F.array_compact(F.array(*found))


def says_true_false(x: ColumnOrName) -> Column:
    return text(x).rlike(r"(?iU)\b(true|false)\b|सही\s*/\s*गलत|सही\s*या\s*गलत")


#: Types of questions; the last but one has no check and never matches. Fixed values.
QUESTION_TYPES = ("Multiple Choice (MCQ)", "Short Answer", "Long Answer", "True/False")


def type_match(kind: ColumnOrName, question: ColumnOrName) -> Column:
    """struct(type_match, type_match_reason): whether a question looks as its type asks."""
    q, k = strip(question), _c(kind)
    options, true_false = F.size(option_markers(q)) >= 4, says_true_false(q)
    match = F.when(k == QUESTION_TYPES[0], options).when(k == QUESTION_TYPES[3], true_false).when(k == QUESTION_TYPES[1], ~options & ~true_false).otherwise(False)
    reason = (
        F.when(k == QUESTION_TYPES[0], F.when(options, "options A to D found").otherwise("options A to D expected"))
        .when(k == QUESTION_TYPES[3], F.when(true_false, "true or false asked").otherwise("true or false expected"))
        .when(k == QUESTION_TYPES[1], F.when(options, "options found").when(true_false, "true or false asked").otherwise("a short answer"))
        .otherwise("no check for this type")
    )
    return F.struct(match.alias("type_match"), reason.alias("type_match_reason"))


#: LaTeX commands and the signs that stand for them. Fixed values.
LATEX = (("cdot", "×"), ("times", "×"), ("Delta", "Δ"), ("neq", "≠"), ("leq", "≤"), ("geq", "≥"))


def latex_to_text(x: ColumnOrName) -> Column:
    """Plain text for common LaTeX commands."""
    t = F.regexp_replace(text(x), r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1/$2)")
    for command, sign in LATEX:
        t = F.replace(t, F.lit(f"\\{command}"), F.lit(sign))
    return F.replace(F.regexp_replace(t, r"\\text\{([^}]+)\}", "$1"), F.lit("$"), F.lit(""))


def html_escape(x: ColumnOrName) -> Column:
    t = text(x)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def wrap_label(x: ColumnOrName) -> Column:
    """Up to four words, then on a second line up to four, with dots if there are more."""
    w = F.filter(F.split(text(x), r"(?U)\s+"), lambda p: p != "")
    two = F.concat(F.array_join(F.slice(w, 1, 4), " "), F.lit("\n"), F.array_join(F.slice(w, 5, 4), " "))
    return F.when(F.size(w) <= 4, F.array_join(w, " ")).when(F.size(w) <= 8, two).otherwise(F.concat(two, F.lit("...")))


# Prompts ---------------------------------------------------------------------------------------


def estimated_tokens(x: ColumnOrName) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text(x)) / 4)).cast("int")


def is_understanding(depth: ColumnOrName) -> Column:
    d = F.lower(text(depth))
    return d.contains("bloom level 2") | d.contains("understand")


#: Bloom levels and the words that name them; the first that fits counts. Fixed values.
BLOOM = ((2, ("bloom level 2", "understand")), (1, ("bloom level 1", "remember", "recall")), (3, ("bloom level 3", "apply")), (4, ("bloom level 4", "analyze")), (5, ("bloom level 5", "evaluate")), (6, ("bloom level 6", "create")))


def bloom_level(depth: ColumnOrName) -> Column:
    """1 to 6, or null."""
    d, out = F.lower(text(depth)), None
    for level, names in BLOOM:
        hit = F.lit(False)
        for n in names:
            hit = hit | d.contains(n)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


def answer_tier(marks: ColumnOrName) -> Column:
    return F.when(_c(marks) > 15, "essay").when(_c(marks) > 5, "paragraphs").otherwise("short")
