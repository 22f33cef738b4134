"""Text, scores, parsing: cases worked out by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.functions import scoring
from marginalia.functions import text as t
from marginalia.operators import chunking, export, parsing, requests


def apply(spark, f, *values, schema=None):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], schema)
    names = df.columns[1:]
    return [r["out"] for r in df.select(df.columns[0], f(*[F.col(n) for n in names]).alias("out")).orderBy(df.columns[0]).collect()]


S1, S2 = "i int, a string", "i int, a string, b string"


def test_languages(spark):
    values = ["abc", "नमस्ते", "abc नम", "123", None]
    assert apply(spark, t.language, *values, schema=S1) == ["en", "hi", "hi", "unknown", "unknown"]
    assert apply(spark, t.language_mixed, *values, schema=S1) == ["en", "hi", "hien", "unknown", "unknown"]


def test_paths(spark):
    got = apply(spark, t.subject_and_block, "rag_store_x/Course A/egyankosh/BLOCK 2/Unit-1", "a/b/c", "rag_store/Block 1", None, "x\\y Block\\z", schema=S1)
    assert got == [Row(subject="Course A", block="BLOCK 2"), Row(subject="b", block=None), Row(subject="rag_store", block="Block 1"), Row(subject=None, block=None), Row(subject="x", block="y Block")]


def test_block_labels(spark):
    got = apply(spark, t.block_label, ("my_block-1", "Block 1 Kalidasa Unit 1"), ("Block 3", None), ("x", "y"), ("BLOCK 4", "BLOCK INTRODUCTION "), (None, None), schema=S2)
    assert got == ["BLOCK 1 KALIDASA", "BLOCK 3", "BLOCK UNSPECIFIED", "BLOCK 4", "BLOCK UNSPECIFIED"]
    assert apply(spark, t.block_number, "a/Block 08.pdf", "notes.txt", "block", schema=S1) == ["Block 8", "notes", "block"]


def test_garbage_boundaries(spark):
    assert apply(spark, t.is_garbage, "a" * 49, "a" * 90 + "é" * 10, "a" * 89 + "é" * 11, None, schema=S1) == [True, False, True, True]


def test_citations(spark):
    assert apply(spark, t.citation_markers, "(p. 175)", "(1999)", "(p. 1999)", "x\n(Reprinted 2019)", "\n(Rajan, 29)", None, schema=S1) == [["(p. 175)"], [], ["(p. 1999)"], [], ["(Rajan, 29)"], []]
    assert apply(spark, t.strip_citations, "To be (p. 12) or not (20)", None, schema=S1) == ["To be or not", ""]
    assert apply(spark, t.locator, "x (Canto II, 4) y", "see p. 77", "none", schema=S1) == ["Canto II, 4", "77", None]
    assert apply(spark, t.split_citation, "Yes.\nCitation: abc", "no", None, "Citation:", schema=S1) == [Row(answer="Yes.", citation="abc"), Row(answer="no", citation=None), Row(answer=None, citation=None), Row(answer="", citation=None)]


def test_cleaning(spark):
    assert apply(spark, t.sanitize, "a\x07b\r\nc\r\r\r\r d​  e ", None, schema=S1) == ["a b\nc\n\n d e", ""]
    assert apply(spark, t.clean_page, "12\nbody, text.\nThe Big Heading\n7", "a..........b", schema=S1) == ["body, text.", "ab"]
    assert apply(spark, t.strip_fences, "```json\n[1]\n```", "[1]", schema=S1) == ["[1]", "[1]"]


def test_question_types(spark):
    kinds = t.QUESTION_TYPES
    mcq = "Q\nA) a\nB. b\nC: c\nD- d"
    got = apply(spark, lambda k, q: t.type_match(k, q)["type_match"], (kinds[0], mcq), (kinds[0], mcq[:-4]), (kinds[1], "is it true"), (kinds[2], "anything"), (kinds[3], "सही / गलत"), (None, "x"), schema=S2)
    assert got == [True, False, False, False, True, False]


def test_levels(spark):
    marks = ["unit 3", "1.2", "1.2.3", "1.2.3.4.5.6", "figure 3", "figure 3.1", "section 2", "subsection 4"]
    assert apply(spark, chunking.infer_level, *marks, schema=S1) == [1, 2, 3, 5, 3, 2, 1, 2]


def test_likert(spark):
    f = lambda x: scoring.expected_score(scoring.distribution(x, (1, 2)))
    got = apply(spark, f, '<OUTPUT>{"1":0.2,"2":0.6}</OUTPUT>', '{"1":0,"2":0}', '{"1":-1,"2":1}', "not JSON", "{'1': 0.5, '2': 0.5}", None, schema=S1)
    assert got == pytest.approx([1.75, 1.5, 2.0, 1.5, 1.5, 1.5])


def test_gate_is_half_even(spark):
    df = spark.createDataFrame([(4.25, 4.0, 1.5, True), (4.25, 4.0, 1.49, True), (4.0, 4.0, 2.0, False)], "n double, d double, g double, on boolean")
    assert [r[0] for r in df.select(scoring.alignment("n", "d", "g", enabled=F.col("on"))).collect()] == [4.12, 0.0, None]


def test_budgets(spark):
    df = spark.createDataFrame([("m", 2, "Multiple Choice (MCQ)"), ("m", 10, "Short Answer"), ("groq-llama-guard", 1, ""), ("m", None, None)], "m string, n int, k string")
    assert [r[0] for r in df.select(scoring.token_budget("m", "n", "k")).collect()] == [6820, 8192, 512, 6350]


def test_questions(spark):
    got = apply(spark, parsing.questions, '```json\n[{"question":" q ","answer":"a"}]\n```', '{"questions":[{"question":"x"},{"question":"y","citation":"c"}, 3]}', '{"question":"one","rubric":{"k":1}}', "<Question>a<Answer>b", "plain text ", "", None, "[1,2] trailing", schema=S1)
    pairs = [[(q["question"], q["answer"]) for q in qs] for qs in got]
    assert pairs == [[("q", "a")], [("x", ""), ("y", "")], [("one", "")], [("a", "b")], [("plain text", "")], [], [], [("[1,2] trailing", "")]]
    assert got[1][1]["citation"] == "c" and got[2][0]["rubric"] == '{"k":1}'


def test_reviews(spark):
    bodies = [f"<Rating>{b}</Rating>" for b in ("7", "8/10", "good")] + ["free"]
    assert [r["rating"] for r in apply(spark, parsing.review, *bodies, schema=S1)] == [7, 8, None, None]


def test_rubric(spark):
    f = lambda x: export.rubric_total(export.rubric(x))
    assert apply(spark, f, '{"marks":[{"marks":"2"},{"score":"3"},{"value":"x"}]}', '{"total":"20"}', "{}", None, "broken", schema=S1) == [5, 20, 10, 10, 10]


def test_prompt_sizes_and_queries(spark):
    assert apply(spark, t.estimated_tokens, "", "123456789", schema=S1) == [1, 2]
    df = spark.createDataFrame([("s", "", ""), ("s", "c", None)], "s string, c string, t string")
    assert [r[0] for r in df.select(requests.search_query("s", "c", "t")).collect()] == ["s", "c"]


def test_fan_out(spark):
    rows = requests.fan_out(spark.createDataFrame([(1, 5), (2, 0)], "id int, num_questions int")).orderBy("id", "task_idx").collect()
    assert [(r["id"], r["task_size"]) for r in rows] == [(1, 2), (1, 2), (1, 1)]


def test_request_problems(spark):
    df = spark.createDataFrame([("Essay", 0, 2.0, 30.0, "zz", "m1", ["m1", "q"]), ("Short Answer", None, None, None, None, None, None)], "k string, n int, t double, r double, m string, c string, ms array<string>")
    allowed = F.array(F.lit("m1"))
    bad, good = requests.split_valid(df, requests.problems("k", "n", "t", "r", "m", "c", "ms", allowed))[::-1]
    assert good.count() == 1 and bad.first()["problems"] == ["question type", "number of questions", "temperature", "rubric marks", "model", "chairman among members", "unknown member"]
