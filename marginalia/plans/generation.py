"""Generation of questions: prompts, models, board, parsing, scores. Models are functions that are passed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.scoring import alignment, distribution, expected_score, language_score
from marginalia.functions.text import strip_thinking, type_match
from marginalia.operators.parsing import explode_questions, questions, review, useful_alternatives
from marginalia.plans.answers import Model, ask
from marginalia.sources.shared import scratch


def run_model(prompts: DataFrame, model: Model, prompt: str = "prompt", model_col: str = "model_id", out: str = "output", store: str | None = None) -> DataFrame:
    """prompts with the model's outputs, each different prompt asked for once, at once; a failure becomes a tagged text."""
    return ask(prompts, model, store, prompt, model_col, out)


def judge(rows: DataFrame, model: Model, judge_id: str, prompt: str, scale: tuple[int, ...], name: str, store: str | None = None) -> DataFrame:
    """rows with a score: the mean of the distribution that a judge gives, to two decimals."""
    x = run_model(rows.withColumn("judge_id", F.lit(judge_id)), model, prompt, "judge_id", "judged", store)
    score = F.bround(expected_score(distribution(strip_thinking("judged"), scale)), 2)
    return x.withColumn(name, score).drop("judge_id", "judged")


def score(rows: DataFrame, model: Model, judges: dict[str, tuple[str, tuple[int, ...]]], prompt: str = "judge_prompt", enabled: str | None = None, store: str | None = None) -> DataFrame:
    """rows (question, answer, language, judge_prompt) with the scores of judges (ncert, qtype, guard, validity, dok), language_score and alignment_score."""
    store = store or scratch(rows.sparkSession, "answers")  # what several scores ask alike is asked once
    for name, (judge_id, scale) in judges.items():
        rows = judge(rows, model, judge_id, prompt, scale, name, store)
    rows = rows.withColumn("language_score", language_score("question", "answer", "language"))
    on = F.col(enabled) if enabled else None
    return rows.withColumn("alignment_score", alignment("ncert", "dok", "guard", "validity", "qtype", "language_score", enabled=on))


def board(requests: DataFrame, model: Model, most: str = "num_questions", store: str | None = None) -> DataFrame:
    """requests (request_id, prompt, chairman, members, num_questions) through proposal, reviews and synthesis.

    Returns a row a question, with the reviews: parsed from the synthesis, or else from the proposal. What is
    reviewed is the proposal that the synthesis gets: answers are read from a table, by their prompts.
    """
    x = run_model(requests, model, "prompt", "chairman", "proposal", store)
    each = x.select("request_id", "proposal", F.posexplode("members").alias("member_no", "member"))
    each = run_model(each.withColumn("review_prompt", F.concat(F.lit("Review this proposal.\n\n"), F.col("proposal"))), model, "review_prompt", "member", "raw_output", store)
    each = each.withColumn("r", review("raw_output"))
    reviews = each.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("member_no", F.char(65 + F.col("member_no")).alias("letter"), F.col("member").alias("model_id"), "r.rating", "r.feedback", "r.alternative", "raw_output"))).alias("reviews"))
    x = x.join(reviews, "request_id", "left")
    said = F.array_join(F.concat(F.transform("reviews", lambda r: F.concat(r["letter"], F.lit(": "), r["feedback"])), useful_alternatives(F.col("reviews"))), "\n\n")
    x = run_model(x.withColumn("synthesis_prompt", F.concat_ws("\n\n", F.lit("Settle on the final questions."), F.col("proposal"), said)), model, "synthesis_prompt", "chairman", "final", store)
    best = F.when(F.size(questions("final")) > 0, F.col("final")).otherwise(F.col("proposal"))
    return explode_questions(x.withColumn("best", best).drop("synthesis_prompt", "final"), "best", most).drop("best", "proposal")


def single(requests: DataFrame, model: Model, store: str | None = None) -> DataFrame:
    """requests (request_id, prompt, model_id, num_questions, qtype) to questions with the check of their type."""
    x = explode_questions(run_model(requests, model, store=store), "output", "num_questions").withColumn("t", type_match("qtype", "question"))
    made = F.count("*").over(Window.partitionBy("request_id")).cast("int")
    return x.select("*", "t.*").drop("t", "output").withColumn("generated_count", made)


def chat(sessions: DataFrame, model: Model, default: str = "No reply.", store: str | None = None) -> DataFrame:
    """sessions (transcript, chunk_text, model_id) with reply, grounded in the chunk's text."""
    x = sessions.withColumn("chat_prompt", F.concat_ws("\n\n", F.concat(F.lit("Source:\n"), F.col("chunk_text")), F.col("transcript"), F.lit("Assistant:")))
    x = run_model(x, model, "chat_prompt", "model_id", "reply", store)
    return x.withColumn("reply", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), F.lit(default))).drop("chat_prompt")
