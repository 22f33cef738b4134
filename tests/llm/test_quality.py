import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import oracles, quality, queries
from tests.llm.fixtures import SCHEMA, awkward, docs
from tests.llm.sql import same_rows


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    extra = [(5000 + k, t, "en", "s1", 0, None) for k, t in enumerate(["a a a a", "a b c a b c", "a b a b a", "x\nx\n\n\nx y\n x", "1 2 3 4 1 2 3 5 2 3 4"])]
    rows = awkward() + extra
    got = quality.measured(docs(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *measures(r[1])) for r in rows), key=repr)


def test_verdicts(spark, sf_dir):
    x = queries.op5_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = x.filter("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = x.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.98 and junk <= 0.05
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    assert x.filter(failed != F.col("base_failed")).isEmpty() and x.filter("base_failed AND kept").isEmpty()


def test_awkward_and_empty(spark):
    got = quality.judge(docs(spark))
    assert got.count() == len(awkward()) and got.filter("kept IS NULL OR base_failed IS NULL").isEmpty() and "extra" in got.columns
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = docs(spark).withColumns({"n_words": F.lit(1000), "N_Repeat_Words": F.lit(0), "kept": F.lit("x"), "q_source": F.lit("mine"), "q_counts": F.lit(3)})
    own = quality.judge(clash)
    assert {r["q_source"] for r in own.collect()} == {"mine"} and "q_counts" in own.columns
    names = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    assert sorted(map(tuple, own.select(*names).collect()), key=repr) == sorted(map(tuple, got.select(*names).collect()), key=repr)
    with pytest.raises(ValueError, match="kept"):
        quality.judge(docs(spark).withColumnRenamed("text", "kept"), text_col="kept")


def test_fences_follow_the_source(spark):
    """The same text is kept in a source where symbols are common and dropped in one where they are not; reruns agree."""
    r = random.Random(3)
    some = lambda n, share: " ".join(f"w{r.randrange(5000)}" + ("#" if r.random() < share else "") for _ in range(n))
    rows = [(k, some(r.randint(60, 400), 0.0), "en", "plain", 0, None) for k in range(400)]
    rows += [(1000 + k, some(r.randint(60, 400), r.uniform(0.3, 0.9)), "en", "code", 0, None) for k in range(400)]
    odd = some(200, 0.5)
    rows += [(5000, odd, "en", "plain", 0, None), (5001, odd, "en", "code", 0, None), (5002, odd, "en", None, 0, None)]
    judged = lambda: {x["doc_id"]: x["kept"] for x in quality.judge(docs(spark, rows)).collect()}
    got = judged()
    assert not got[5000] and got[5001] and judged() == got
    assert sum(got.values()) >= 0.97 * len(rows)
    x = quality.with_levels(quality.measured(docs(spark, rows))).withColumns({"q_lang": F.col("lang"), "q_source": F.coalesce("source", F.lit(""))})
    assert quality.fences(x).select("q_top_symbol_rate").distinct().count() == 3


def test_groups_of_the_tables_have_fences_of_their_own(spark, sf_dir):
    x = quality.with_levels(quality.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumns({"q_lang": F.col("lang"), "q_source": F.col("source")})
    f = quality.fences(x.filter("n_words >= 50"))
    assert all(f.select(f"q_top_{m}").distinct().count() >= 0.5 * f.count() for m in quality.REACH)


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op5_quality_rules(spark, sf_dir), oracles.oracle_sql()["op5_quality_rules"], sf_dir)


def test_short_clean_texts_are_kept_among_long_ones(spark):
    """Texts without a symbol or a repeat, of lengths that are rare in their group."""
    r = random.Random(9)
    some = lambda n: " ".join(f"w{r.randrange(90000):05d}" for _ in range(n))
    rows = [(k, some(r.randint(1900, 2100)), "en", "long", 0, None) for k in range(300)]
    rows += [(1000 + n, some(n), "en", "long", 0, None) for n in (55, 80, 150, 300, 600, 1200, 9000)]
    rows += [(5000, some(80) + " #" * 30, "en", "long", 0, None), (5001, " ".join("x" for _ in range(300)) + some(20), "en", "long", 0, None)]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(docs(spark, rows)).collect()}
    assert {k for k, v in got.items() if not v} == {5000, 5001}


def test_a_text_without_any_is_never_beyond_a_rate(spark):
    rows = [(k, 60 + 40 * (k % 50), "en", "s") for k in range(500)]
    x = spark.createDataFrame(rows, "doc_id long, n_words long, lang string, source string")
    x = x.withColumns({"word_chars": F.col("n_words") * 5, "n_symbols": F.lit(0).cast("long"), "n_lines": F.lit(3).cast("long"), "n_dup_lines": F.lit(0).cast("long"), "n_repeat_words": F.lit(0).cast("long")})
    assert quality.verdicts(x).filter("NOT kept").isEmpty()
