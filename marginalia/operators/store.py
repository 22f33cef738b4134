"""The store of sessions and questions, as append-only tables.

Counters and states are logs of events that are summed, or of which the last counts; a row's order is
its row_index, given when it is written.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import ColumnOrName, _c, blank_to_null, strip
from marginalia.operators.ordering import numbered

SESSION = "id string, created_at timestamp, status string, total_requested int, total_generated int, parameters string"
QUESTION = (
    "row_index bigint, id string, session_id string, created_at timestamp, question string, answer string, alignment_score double, subject string, chapter string, depth string, qtype string, language string, "
    "model_id string, scores string, source_text string, source_meta string, rubric string, board_metadata string, request string, is_rag boolean, use_citation boolean, type_match boolean, "
    "type_match_reason string, requested_count int, generated_count int, count_warning boolean, generation_time_ms double, citation string"
)


def fields(ddl: str) -> list[tuple[str, str]]:
    """Names and types of columns, none of them nested."""
    return [tuple(f.split(" ")) for f in ddl.split(", ")]


def evolve(df: DataFrame, wanted: str) -> DataFrame:
    """df with the columns that it lacks added at its end, as nulls; nothing else changes."""
    have = set(df.columns)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in fields(wanted) if n not in have})


def new_questions(parsed: DataFrame, first_index: int = 0, key: Iterable[str] = ("session_id", "idx"), default_model: str = "groq-llama-70b") -> DataFrame:
    """Rows to append: texts stripped, structures as JSON, keys from the key columns, and the rows' order."""
    x = parsed
    for n, _ in fields(QUESTION):
        if n in x.columns and isinstance(x.schema[n].dataType, (T.StructType, T.MapType, T.ArrayType)):
            x = x.withColumn(n, F.to_json(n))
    keys = list(key)
    x = x.withColumns({"question": strip("question"), "answer": strip("answer"), "id": F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))})
    model = blank_to_null(F.col("model_id")) if "model_id" in x.columns else F.lit(None).cast("string")
    x = x.withColumn("model_id", F.coalesce(model, F.lit(default_model)))
    x = numbered(x, tuple(keys), "row_index").withColumn("row_index", F.col("row_index") + (first_index - 1))
    return evolve(x, QUESTION).select(*[F.col(n).cast(t) for n, t in fields(QUESTION)])


def new_session(request: DataFrame) -> DataFrame:
    """requests (id, created_at, total_requested, parameters) as pending sessions."""
    return request.select("id", F.col("created_at").cast("timestamp"), F.lit("pending").alias("status"), F.col("total_requested").cast("int"), F.lit(0).alias("total_generated"), F.to_json("parameters").alias("parameters"))


def progress(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """sessions with total_generated and status from events (session_id, seq, n, status): the sum of n, and the last status.

    A session that reached its number is completed, whatever came last.
    """
    done = events.groupBy("session_id").agg(F.sum("n").alias("g"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("s"))
    x = sessions.join(done, sessions["id"] == done["session_id"], "left")
    made = F.coalesce("g", F.lit(0)) + F.coalesce("total_generated", F.lit(0))
    status = F.when(made >= F.col("total_requested"), "completed").otherwise(F.coalesce("s", "status"))
    return x.withColumns({"total_generated": made.cast("int"), "status": status}).drop("g", "s", "session_id")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("nth = 1").drop("nth")


def append_once(held: DataFrame, more: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """held and those of more whose key it does not have, one a key; null is a key like others."""
    keys = held.select(*[F.col(k).alias(f"held_{n}") for n, k in enumerate(key)]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"held_{n}")) for n, k in enumerate(key)])
    return held.unionByName(more.join(keys, same, "left_anti").dropDuplicates(list(key)))


# Reading ---------------------------------------------------------------------------------------


def recent(sessions: DataFrame, n: int = 50) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "id").limit(n)


def page(questions: DataFrame, offset: int = 0, limit: int = 25, order: str = "row_index") -> DataFrame:
    """Newest first."""
    return questions.orderBy(F.desc(order)).offset(offset).limit(limit)


def of_session(questions: DataFrame, session_id: str) -> DataFrame:
    return questions.filter(F.col("session_id") == session_id).orderBy("row_index")


def with_questions(sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """Sessions beside their questions; one without any stays."""
    return sessions.join(questions.drop("created_at", "id"), sessions["id"] == questions["session_id"], "left").drop("session_id")


def bounds(questions: DataFrame, key: str = "id", order: str = "row_index") -> DataFrame:
    """One row: earliest_id, latest_id."""
    return questions.agg(F.min_by(key, order).alias("earliest_id"), F.max_by(key, order).alias("latest_id"))


def navigation(questions: DataFrame, key: str = "id", order: str = "row_index", blocks: int = 64) -> DataFrame:
    """questions with prev_id, next_id, has_prev, has_next.

    Rows are dealt into ranges of the order; neighbours across two ranges come from a table of the
    ranges' first and last rows, so that no task holds all rows.
    """
    low, high = questions.agg(F.min(order), F.max(order)).first()
    if low is None:
        low, high = 0, 0
    width = max(1, -(-(high - low + 1) // blocks))
    x = questions.withColumn("nav_block", F.floor((F.col(order) - low) / width))
    by = Window.partitionBy("nav_block").orderBy(order)
    x = x.withColumns({"nav_prev": F.lag(key).over(by), "nav_next": F.lead(key).over(by)})
    ends = questions.withColumn("nav_block", F.floor((F.col(order) - low) / width)).groupBy("nav_block").agg(F.min_by(key, order).alias("f"), F.max_by(key, order).alias("l"))
    whole = Window.orderBy("nav_block")
    ends = ends.select("nav_block", F.lag("l").over(whole).alias("nav_before"), F.lead("f").over(whole).alias("nav_after"))
    x = x.join(ends, "nav_block")
    x = x.withColumns({"prev_id": F.coalesce("nav_prev", "nav_before"), "next_id": F.coalesce("nav_next", "nav_after")})
    x = x.withColumns({"has_prev": F.col("prev_id").isNotNull(), "has_next": F.col("next_id").isNotNull()})
    return x.drop("nav_block", "nav_prev", "nav_next", "nav_before", "nav_after")


def question_view(questions: DataFrame, action: str = "latest", question_id: str | None = None) -> DataFrame:
    """The row that an action leads to, with has_prev and has_next; none for an unknown action or id.

    Keyset reads: one row by the order next to the current one, not a pass over all.
    """
    if action in ("latest", "earliest"):
        row = questions.orderBy(F.desc("row_index") if action == "latest" else "row_index").limit(1)
    elif action in ("current", "next", "prev") and question_id is not None:
        row = questions.filter(F.col("id") == question_id).limit(1)
        if action != "current":
            at = row.select("row_index").first()
            here = F.lit(at[0] if at else None).cast("long")
            row = questions.filter(F.col("row_index") > here).orderBy("row_index").limit(1) if action == "next" else questions.filter(F.col("row_index") < here).orderBy(F.desc("row_index")).limit(1)
    else:
        row = questions.limit(0)
    ends = questions.agg(F.min("row_index").alias("lo"), F.max("row_index").alias("hi")).first()
    return row.withColumns({"has_prev": F.col("row_index") > F.lit(ends["lo"]), "has_next": F.col("row_index") < F.lit(ends["hi"])})


# Columns ---------------------------------------------------------------------------------------


def json_or_text(x: ColumnOrName, kind: str) -> Column:
    """struct(value, raw): the parsed value, or the text where it does not parse."""
    value = F.from_json(_c(x), kind)
    ok = F.try_parse_json(_c(x)).isNotNull()
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, _c(x)).alias("raw"))


def normalized(questions: DataFrame) -> DataFrame:
    """questions with category, question_text, answer_text, scores as a map (empty if there are none) and flags as booleans."""
    scores = F.coalesce(F.from_json("scores", "map<string,double>"), F.create_map().cast("map<string,double>"))
    flag = lambda c: F.coalesce(_c(c), F.lit(False))
    return questions.withColumns({"category": F.col("depth"), "question_text": F.col("question"), "answer_text": F.col("answer"), "scores": scores, "is_rag": flag("is_rag"), "use_citation": flag("use_citation")})


def request_summary(x: ColumnOrName) -> Column:
    """What a request asked for, from its JSON; flags that lack are on."""
    r = F.from_json(_c(x), "subject string, chapter string, language string, num_questions int, use_rag boolean, enable_alignment boolean, enable_dynamic_dropoff boolean")
    on = lambda n: F.coalesce(r[n], F.lit(True)).alias(n)
    return F.struct(r["subject"].alias("subject"), r["chapter"].alias("chapter"), r["language"].alias("language"), r["num_questions"].alias("num_questions"), on("use_rag"), on("enable_alignment"), on("enable_dynamic_dropoff"))


def enrich(questions: DataFrame, by: str, requested: ColumnOrName) -> DataFrame:
    """questions with requested_count, generated_count (of its batch) and count_warning."""
    made = F.count("*").over(Window.partitionBy(by)).cast("int")
    x = questions.withColumns({"requested_count": _c(requested).cast("int"), "generated_count": made})
    return x.withColumn("count_warning", F.col("generated_count") < F.col("requested_count"))
