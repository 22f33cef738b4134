"""Requests: checks, models, budgets, work splitting, prompts and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import QUESTION_TYPES, ColumnOrName, _c, answer_tier, blank_to_null, bloom_level, estimated_tokens, strip, text, word_count


def problems(qtype: ColumnOrName, n: ColumnOrName, temperature: ColumnOrName, marks: ColumnOrName, model: ColumnOrName, chairman: ColumnOrName, members: ColumnOrName, allowed: Column) -> Column:
    """array of what is wrong with a request; empty if it is fine."""
    m = _c(members)
    return F.array_compact(F.array(
        F.when(~F.coalesce(_c(qtype).isin(*QUESTION_TYPES), F.lit(False)), "question type"),
        F.when(F.coalesce(_c(n), F.lit(1)) < 1, "number of questions"),
        F.when(~F.coalesce(_c(temperature), F.lit(0.7)).between(0, 1), "temperature"),
        F.when(~F.coalesce(_c(marks), F.lit(5.0)).between(0.1, 20), "rubric marks"),
        F.when(_c(model).isNotNull() & ~F.array_contains(allowed, F.coalesce(_c(model), F.lit(""))), "model"),
        F.when(F.array_contains(m, _c(chairman)), "chairman among members"),
        F.when(_c(chairman).isNotNull() & (F.coalesce(F.size(m), F.lit(0)) == 0), "no members"),
        F.when(F.size(F.array_except(m, allowed)) > 0, "unknown member"),
    ))


def split_valid(requests: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Requests without problems, and those with them (in the column problems)."""
    x = requests.withColumn("problems", problem)
    return x.filter(F.size("problems") == 0).drop("problems"), x.filter(F.size("problems") > 0)


def model_id(x: ColumnOrName, fallback: str) -> Column:
    """A known provider's model, or the fallback; an old alias becomes the model it stands for."""
    v = strip(x)
    known = v.startswith("groq-") | v.startswith("ollama-") | (v == "rag-piped-groq-70b")
    return F.when(v == "rag-piped-groq-70b", "groq-llama-70b").when(known, v).otherwise(fallback)


def search_query(subject: ColumnOrName, chapter: ColumnOrName, theme: ColumnOrName) -> Column:
    """Chapter and theme, or the subject if both are empty."""
    return F.coalesce(blank_to_null(strip(F.concat_ws(" ", text(chapter), text(theme)))), _c(subject))


def chat_subject(subject: ColumnOrName, class_level: ColumnOrName) -> Column:
    return F.when(text(subject).contains("Math"), "Maths").when(_c(class_level) == 10, "Science").otherwise(_c(subject))


def fan_out(requests: DataFrame, n: ColumnOrName = "num_questions", size: int = 2) -> DataFrame:
    """requests with task_idx and task_size: one row for every size questions or part of them."""
    total = _c(n).cast("int")
    tasks = F.ceil(total / size).cast("int")
    x = requests.withColumn("task_idx", F.explode(F.sequence(F.lit(0), F.greatest(tasks, F.lit(1)) - 1)))
    return x.withColumn("task_size", F.least(F.lit(size), total - size * F.col("task_idx"))).filter("task_size > 0")


def prompt(source: ColumnOrName, subject: ColumnOrName, chapter: ColumnOrName, qtype: ColumnOrName, n: ColumnOrName, depth: ColumnOrName, language: ColumnOrName, marks: ColumnOrName, cite: ColumnOrName, keywords: ColumnOrName = None) -> Column:
    """A generation prompt: sections for the source, the citation mode, depth, length and output, each only where it applies."""
    length = F.when(answer_tier(marks) == "essay", "an essay with introduction, body and conclusion").when(answer_tier(marks) == "paragraphs", "two or three paragraphs").otherwise("four or five sentences")
    flag = lambda c: F.coalesce(_c(c), F.lit(False))
    tasks = F.lit(True) if keywords is None else F.coalesce(_c(keywords), F.lit(True))
    return F.concat_ws(
        "\n\n",
        F.when(text(source) != "", F.concat(F.lit("# Source\n"), text(source))),
        F.when(flag(cite), "# Citation\nQuote one passage of the source word for word in `citation`, without page marks.").otherwise("# No citation\nDo not mention the source."),
        F.concat(F.lit("# Task\nWrite "), F.greatest(F.lit(1), F.coalesce(_c(n), F.lit(1))).cast("string"), F.lit(" question(s) of type "), text(qtype), F.lit(" on "), text(chapter), F.lit(" ("), text(subject), F.lit(").")),
        F.concat(F.lit("# Depth\n"), F.coalesce(F.concat(F.lit("Bloom level "), bloom_level(depth).cast("string")), F.lit("As fits the level asked for"))),
        F.concat(F.lit("# Answer\nGive "), length, F.lit(".")),
        F.when(tasks, "# Verbs\nUse verbs such as discuss, differentiate, examine, explain."),
        F.when(F.lower(text(language)) == "hi", "# Language\nHindi, in Devanagari.").otherwise("# Language\nEnglish."),
    )


def prompt_stats(x: DataFrame, column: str, repeated: tuple[str, ...] = ()) -> DataFrame:
    """x with chars, words, est_tokens of the prompt, and n_<k> for each phrase whose repetition is of interest."""
    p = text(column)
    counts = {f"n_{k}": F.regexp_count(p, F.lit("\\Q" + phrase + "\\E")) for k, phrase in enumerate(repeated)}
    return x.withColumns({"chars": F.length(p), "words": word_count(p), "est_tokens": estimated_tokens(p)} | counts)


def transcripts(turns: DataFrame, by: str, order: str, role: str = "role", body: str = "text", block: int = 1000) -> DataFrame:
    """by, part, transcript: a chat as lines of role and text. Chats of more than block turns come in parts, in order."""
    x = turns.select(by, F.floor((F.col(order)) / block).alias("part"), F.struct(F.col(order).alias("o"), F.concat(F.initcap(text(role)), F.lit(": "), text(body)).alias("t")).alias("s"))
    return x.groupBy(by, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("transcript"))


def whole_transcripts(turns: DataFrame, by: str, order: str, role: str = "role", body: str = "text", block: int = 1000) -> DataFrame:
    """by, transcript: all parts of a chat, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("part", "transcript")))
    return transcripts(turns, by, order, role, body, block).groupBy(by).agg(F.array_join(F.transform(parts, lambda s: s["transcript"]), "\n").alias("transcript"))


def joined_deltas(deltas: DataFrame, by: str, order: str, body: str) -> DataFrame:
    """by, text: the pieces of a streamed answer in order."""
    return deltas.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda s: s[body]), "").alias("text"))


def numbered(x: DataFrame, by: tuple[str, ...], order: str, name: str = "row_no") -> DataFrame:
    return x.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def newest_first(x: DataFrame, by: tuple[str, ...], at: str, tie: str, name: str = "place") -> DataFrame:
    """x with the place of each row in its group, the latest first; of equally late ones by tie."""
    return x.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), tie)))


def first_rows(x: DataFrame, by: str, order: str, most: ColumnOrName) -> DataFrame:
    """At most so many rows of each group."""
    return numbered(x, (by,), order, "nth").filter(F.col("nth") <= _c(most)).drop("nth")


def page_number(wanted: ColumnOrName, total: ColumnOrName) -> Column:
    """A page within 1 and the total."""
    return F.greatest(F.lit(1), F.least(_c(wanted), _c(total)))


def chat_form(subject: ColumnOrName, language: ColumnOrName, class_level: ColumnOrName, chapter: ColumnOrName, topic: ColumnOrName, theme: ColumnOrName) -> Column:
    """A form's fields as JSON, with the text to talk about: topic and theme, one empty line between."""
    body = F.concat_ws("\n\n", blank_to_null(_c(topic)), blank_to_null(_c(theme)))
    return F.to_json(F.struct(chat_subject(subject, class_level).alias("subject"), _c(language).alias("language"), _c(class_level).alias("class_level"), _c(chapter).alias("chapter"), body.alias("chunk_text")))
