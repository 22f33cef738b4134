"""Which texts hold which parts, by trigrams, against all pairs."""

import random

import pytest

from marginalia.operators import citations, containment


def frames(spark, said, asked):
    return spark.createDataFrame([(x,) for x in said], "said string").repartition(3), spark.createDataFrame([(x,) for x in asked], "asked string")


@pytest.mark.parametrize("piece", [3, 10_000])
def test_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(containment, "PIECE", piece)
    r = random.Random(2)
    said = ["".join(r.choice("abcé ") for _ in range(r.randrange(0, 12))) for _ in range(300)] + ["course one", "course two", "course one", None, "", "日本語の本"]
    asked = ["".join(r.choice("abcé ") for _ in range(r.randrange(0, 6))) for _ in range(100)] + ["", "course", "one", "urse t", None, "語の", "zzz", "日本語の本", "abcd%_"]
    got = [(x["said"], x["asked"]) for x in containment.containing(*frames(spark, said, asked)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(s, a) for s in said if s is not None for a in asked if a is not None and a in s}
    assert containment.containing(*frames(spark, [], asked)).count() == containment.containing(*frames(spark, said, [])).count() == 0


def test_many_subjects_without_a_nested_loop(spark):
    """10^5 texts and parts; each part is in one text, or in two."""
    said = spark.range(100_000).selectExpr("concat('course ', md5(string(id)), ' of year ', id % 7) AS said")
    asked = spark.range(100_000).selectExpr("concat('e ', left(md5(string(id * 2)), 14)) AS asked")
    found = containment.containing(said, asked)
    assert found.count() == 50_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_citations_of_requests(spark):
    cites = spark.createDataFrame([(k % 20, f"citation {k}") for k in range(60)], "document_id int, citation_text string")
    docs = spark.createDataFrame([(k, f"Course {k % 4}") for k in range(20)], "document_id int, subject string")
    asked = spark.createDataFrame([(n, f"course {n % 5}" if n % 6 else "COURSE") for n in range(30)], "request_id int, subject string")
    got = {r["request_id"]: r["citation_original"] for r in citations.of_documents(cites, docs, asked, "s").collect()}
    pairs = cites.join(docs, "document_id").crossJoin(asked.withColumnRenamed("subject", "asked")).filter("contains(lower(subject), lower(asked))")
    want = {r["request_id"]: r["citation_original"] for r in citations.pick(pairs, ("request_id",), "s").collect()}
    assert got == want and len(got) == sum(n % 6 == 0 or n % 5 < 4 for n in range(30))
