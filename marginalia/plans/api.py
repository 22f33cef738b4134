"""The read interface as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import catalog, export, store


def health(documents: DataFrame, questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: how many documents, questions and sessions there are, and whether the store can serve."""
    d, q, s = (x.agg(F.count("*").alias(n)) for x, n in ((documents, "n_documents"), (questions, "n_questions"), (sessions, "n_sessions")))
    rows = d.select(F.lit("d").alias("k"), F.col("n_documents").alias("n")).union(q.select(F.lit("q"), "n_questions")).union(s.select(F.lit("s"), "n_sessions"))
    of = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")))
    return rows.agg(of("d").alias("n_documents"), of("q").alias("n_questions"), of("s").alias("n_sessions")).withColumn("status", F.when(F.col("n_documents") > 0, "ok").otherwise("empty"))


def session(sessions: DataFrame, events: DataFrame, session_id: str) -> DataFrame:
    return store.progress(sessions.filter(F.col("id") == session_id), events.filter(F.col("session_id") == session_id))


def recent_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    return store.recent(sessions, limit)


def session_questions(questions: DataFrame, session_id: str) -> DataFrame:
    return store.normalized(store.of_session(questions, session_id))


def session_sheet(questions: DataFrame, session_id: str) -> DataFrame:
    return export.sheet(store.of_session(questions, session_id))


def question_list(questions: DataFrame, offset: int = 0, limit: int = 25) -> DataFrame:
    return export.list_view(store.page(questions, offset, limit))


def question_stack(questions: DataFrame, action: str = "latest", question_id: str | None = None) -> DataFrame:
    x = store.normalized(store.question_view(questions, action, question_id))
    return x.withColumn("request_summary", store.request_summary("request"))


def course_blocks(rows: DataFrame, language: str | None = None) -> DataFrame:
    return catalog.course_blocks(rows.filter(F.col("store") == language) if language in ("en", "hi") else rows)
