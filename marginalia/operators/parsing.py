"""Semi-structured model output to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import ColumnOrName, _c, blank_to_null, split_citation, strip, strip_fences, text

#: One question as parsed. rubric is JSON text.
QUESTION = "struct<question:string,answer:string,citation:string,rubric:string>"


def json_payload(x: ColumnOrName) -> Column:
    """The JSON in a text, as text: all of it, else from the first [ to the last ], else from { to }; null if none is valid."""
    t = strip_fences(x)
    tries = [t, F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0)]
    closed = lambda s: s.rlike(r"(?s)\A\s*(?:\{.*\}|\[.*\])\s*\z") & F.try_parse_json(s).isNotNull()
    return F.coalesce(*[F.when(closed(s), s) for s in tries])


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _from_json(payload: Column) -> Column:
    """Questions of a JSON list, of a list under `questions`, or of one object."""
    v = F.try_parse_json(payload)
    items = F.coalesce(F.try_variant_get(v, "$.questions", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(payload.rlike(r"\A\s*\{"), F.array(v)))
    objects = F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT"))

    def question(i: Column) -> Column:
        split = split_citation(strip(F.coalesce(_get(i, "$.answer"), F.lit(""))))
        return F.struct(
            strip(F.coalesce(_get(i, "$.question"), F.lit(""))).alias("question"), strip(split["answer"]).alias("answer"),
            F.coalesce(blank_to_null(_get(i, "$.citation")), split["citation"]).alias("citation"), F.to_json(F.try_variant_get(i, "$.rubric", "variant")).alias("rubric"))

    return F.transform(objects, question)


_Q = r"(?s)<[Qq]uestion>(.*?)(?:</[Qq]uestion>|(?=<[Qq]uestion>|<[Aa]nswer>|\n?\z))"
_A = r"(?s)<[Aa]nswer>(.*?)(?:</[Aa]nswer>|(?=<[Qq]uestion>|<[Aa]nswer>|\n?\z))"


def _from_tags(t: Column) -> Column:
    """Questions between tags, each with the answer of its number; closing tags may lack."""
    questions, answers = F.regexp_extract_all(t, F.lit(_Q), F.lit(1)), F.regexp_extract_all(t, F.lit(_A), F.lit(1))

    def question(q: Column, n: Column) -> Column:
        split = split_citation(strip(F.regexp_replace(F.coalesce(F.get(answers, n), F.lit("")), r"</?[Aa]nswer/?>", "")))
        return F.struct(strip(F.regexp_replace(q, r"</?[Qq]uestion/?>", "")).alias("question"), strip(split["answer"]).alias("answer"), split["citation"].alias("citation"), F.lit(None).cast("string").alias("rubric"))

    return F.transform(questions, question)


def questions(x: ColumnOrName) -> Column:
    """array of QUESTION: from JSON, else from tags, else the text as one question; none for the empty text."""
    t = text(x)
    by_json, by_tags = _from_json(json_payload(t)), _from_tags(t)
    raw = F.array(F.struct(strip(t).alias("question"), F.lit("").alias("answer"), F.lit(None).cast("string").alias("citation"), F.lit(None).cast("string").alias("rubric")))
    return F.when(t == "", F.array().cast(f"array<{QUESTION}>")).when(F.size(by_json) > 0, by_json).when(F.size(by_tags) > 0, by_tags).otherwise(raw)


def old_questions(x: ColumnOrName, most: int = 2000) -> Column:
    """array of struct(question, answer) as older outputs had them: tags, else headings QUESTION and ANSWER.

    A missing answer says so; counters, labels and notes that models add are removed; questions that
    are then empty are left out. An answer under a heading has most characters at most.
    """
    t = text(x)
    none = F.lit("No answer provided.")
    tagged = F.transform(F.regexp_extract_all(t, F.lit(_Q), F.lit(1)), lambda q, n: F.struct(q.alias("q"), F.coalesce(F.get(F.regexp_extract_all(t, F.lit(_A), F.lit(1)), n), none).alias("a")))
    head = r"(?:###\s*)?ANSWER\s*\n"
    after = F.left(strip(F.regexp_extract(t, rf"(?is){head}\s*(.*)", 1)), F.lit(most))
    asked = strip(F.regexp_extract(t, rf"(?is)(?:###\s*)?QUESTION\s*\n\s*(.*?)(?={head}|\z)", 1))
    before = strip(F.regexp_extract(t, rf"(?is)\A(.*?){head}", 1))
    before = F.when(F.length(before) < most, before).otherwise(F.concat(F.left(before, F.lit(most - 3)), F.lit("...")))
    question = F.coalesce(blank_to_null(asked), blank_to_null(before), F.lit("Question (its form was not recognised)"))
    headed = F.when(t.rlike(rf"(?i){head}"), F.array(F.struct(question.alias("q"), F.coalesce(blank_to_null(after), none).alias("a"))))
    found = F.when(F.size(tagged) > 0, tagged).otherwise(F.coalesce(headed, F.array().cast("array<struct<q:string,a:string>>")))

    def clean(s: Column) -> Column:
        q, a = strip(F.regexp_replace(s["q"], "</?[Qq]uestion/?>", "")), strip(F.regexp_replace(s["a"], "</?[Aa]nswer/?>", ""))
        q = strip(F.regexp_replace(q, r"(?id)(\*\*Question\s*\d+\*\*|Question\s*\d+:|###.*?\n)", ""))
        return F.struct(q.alias("question"), strip(F.regexp_replace(a, r"(?id)(\*\*Answer\*\*|Answer:|Note:.*\z)", "")).alias("answer"))

    return F.filter(F.transform(found, clean), lambda s: s["question"] != "")


def explode_questions(outputs: DataFrame, column: str = "output", most: ColumnOrName | None = None) -> DataFrame:
    """outputs with idx (from 0), question, answer, citation, rubric; at most so many an output."""
    found = questions(column)
    if most is not None:
        found = F.slice(found, F.lit(1), F.greatest(F.lit(0), _c(most).cast("int")))
    return outputs.select("*", F.posexplode(found).alias("idx", "q")).select(*outputs.columns, "idx", "q.*")


def review(x: ColumnOrName) -> Column:
    """struct(rating, feedback, alternative) of a board member's review."""
    t = text(x)

    def tag(name: str) -> Column:
        pattern = rf"(?s)<{name}>(.*?)</{name}>"
        return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))

    rating = tag("Rating")
    number = F.coalesce(strip(rating).try_cast("int"), F.regexp_extract(rating, r"(\d+)", 1).try_cast("int"))
    return F.struct(F.when(rating.isNotNull(), number).alias("rating"), F.when(tag("Feedback").isNotNull(), strip(tag("Feedback"))).otherwise(t).alias("feedback"),
                    F.when(tag("Alternative").isNotNull(), strip(tag("Alternative"))).otherwise("None").alias("alternative"))


def useful_alternatives(reviews: Column) -> Column:
    """Alternatives that say something, of an array of reviews."""
    alt = F.transform(reviews, lambda r: strip(r["alternative"]))
    return F.filter(alt, lambda a: (a != "") & (F.lower(a) != "none"))


def lettered(ids: Column, outputs: Column) -> Column:
    """Member ids and outputs side by side, lettered A, B, …"""
    return F.transform(F.arrays_zip(ids.alias("model_id"), outputs.alias("output")), lambda z, i: F.struct(F.char(65 + i).alias("letter"), z["model_id"].alias("model_id"), z["output"].alias("output")))
