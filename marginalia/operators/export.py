"""Rubrics, the export sheet, and the derived columns of the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scoring import percent_band, score_color, score_percent
from marginalia.functions.text import ColumnOrName, _c, html_escape, squeeze, strip, text
from marginalia.operators.ordering import numbered

RUBRIC = "struct<marks:array<struct<criterion:string,label:string,name:string,marks:string,score:string,value:string>>,key_points:array<string>,total:string>"
#: Columns of the sheet and their headings; fixed values.
SHEET = {
    "course": "Course", "block": "Block", "bloom_level": "Bloom Level", "question": "Question", "answer": "Answer", "rubric": "Rubric (Marks & Key Points)",
    "valid_qa": "Is this a valid Question and Answer pair? (Yes or No)", "comments": "Comments for your decision",
}


def rubric(x: ColumnOrName) -> Column:
    return F.from_json(_c(x), RUBRIC)


def rubric_text(r: Column) -> Column:
    """A rubric's marks as lines and its key points numbered; empty for none."""
    mark = lambda m: F.concat(F.coalesce(m["criterion"], m["label"], m["name"], F.lit("")), F.lit(" - "), F.coalesce(m["marks"], m["score"], m["value"], F.lit("")), F.lit(" marks"))
    marks = F.array_join(F.transform(r["marks"], mark), "\n")
    points = F.array_join(F.transform(r["key_points"], lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), text(p))), "\n")
    return F.concat_ws("\n\n", F.when(F.size(r["marks"]) > 0, F.concat(F.lit("[Marks]\n"), marks)), F.when(F.size(r["key_points"]) > 0, F.concat(F.lit("[Key Points]\n"), points)))


def rubric_total(r: Column, default: float = 10.0) -> Column:
    """Sum of the numeric marks, else the declared total, else default."""
    value = lambda m: F.coalesce(F.coalesce(m["marks"], m["score"], m["value"]).try_cast("double"), F.lit(0.0))
    finite = lambda v: F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(v)
    total = F.aggregate(F.coalesce(r["marks"], F.array()), F.lit(0.0), lambda a, m: a + finite(value(m)))
    return F.coalesce(F.nullif(total, F.lit(0.0)), F.nullif(r["total"].try_cast("double"), F.lit(0.0)), F.lit(default))


def sheet(questions: DataFrame, headings: bool = False) -> DataFrame:
    """questions (subject, chapter, depth, question, answer, rubric as JSON) as the export sheet, two columns left for reviewers."""
    x = questions.select(
        F.col("subject").alias("course"), F.col("chapter").alias("block"), text("depth").alias("bloom_level"), "question", "answer",
        F.coalesce(rubric_text(rubric("rubric")), F.lit("")).alias("rubric"), F.lit("").alias("valid_qa"), F.lit("").alias("comments"))
    return x.toDF(*SHEET.values()) if headings else x


def print_pages(questions: DataFrame, order: str = "row_index", rows: int = 5) -> DataFrame:
    """questions with row_no and page_no, so many rows a page."""
    x = numbered(questions, (order,), "row_no").withColumn("row_no", F.col("row_no").cast("int"))
    return x.withColumn("page_no", F.floor((F.col("row_no") - 1) / rows).cast("int") + 1)


def list_view(questions: DataFrame, preview: int = 120) -> DataFrame:
    """questions with the badges, colours and previews of the list."""
    one_line = strip(squeeze("question"))
    short = F.when(F.length(one_line) > preview, F.concat(F.left(one_line, F.lit(preview)), F.lit("..."))).otherwise(one_line)
    return questions.withColumns({
        "mode": F.when(F.col("board_metadata").isNotNull(), "Council").otherwise("Single"), "rag": F.when(F.coalesce("is_rag", F.lit(False)), "RAG").otherwise("Direct"),
        "score_color": score_color("alignment_score"), "score_percent": score_percent("alignment_score"), "score_band": percent_band(score_percent("alignment_score")), "preview": html_escape(short),
    })


def session_cards(sessions: DataFrame) -> DataFrame:
    """sessions with percent (null if nothing was asked for) and day, newest first."""
    asked = F.nullif(F.col("total_requested"), F.lit(0))
    return sessions.withColumns({"percent": F.round(100 * F.col("total_generated") / asked).cast("int"), "day": F.date_format("created_at", "yyyy-MM-dd")}).orderBy(F.desc("created_at"), "id")


def filled(entries: Column) -> Column:
    """The entries of a map that say something."""
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))
