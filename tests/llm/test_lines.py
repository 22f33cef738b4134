from collections import defaultdict

from marginalia.llm import line_dedup, oracles, queries
from tests.llm.fixtures import SCHEMA, awkward, docs
from tests.llm.sql import same_rows

ENDS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ENDS))


def brute(rows):
    holds = defaultdict(set)
    last = 1 << 62
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                holds[key(line)].add(last if r[0] is None else r[0])
    out = []
    for r in rows:
        own = (r[1] or "").split("\n")
        i = last if r[0] is None else r[0]
        kept = [x for x in own if len(holds.get(key(x), ())) < 2 or min(holds[key(x)]) == i]
        out.append((r[0], "\n".join(kept), len(own), len(own) - len(kept), r[5]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = awkward()
    for k in range(40):
        rows.append((2000 + k, f"license text that all share\nunique line of document {k}\nÄÖ gemeinsam {k % 5}\ntiny", "en", "s1", 0, "y"))
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "extra", "n_lines", "n_dropped"}
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped", "extra").collect()), key=repr) == brute(rows)


def dropped(got):
    return sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped", "extra").collect()), key=repr)


def test_a_full_filter_changes_nothing(spark):
    rows = awkward()
    assert dropped(line_dedup.dedup_lines(docs(spark, rows), bits_per_line=1, probes=1, range_bits=64)) == brute(rows)


def test_a_filter_too_large_to_broadcast_changes_nothing(spark):
    """Digests go to the owners of the ranges; a line that a third of all documents hold is among them."""
    rows = awkward()
    for k in range(300):
        rows.append((2000 + k, (f"a line that a third hold\n" if k % 3 == 0 else "") + f"unique line of document {k}\nshared by two of them {k // 2}", "en", "s1", 0, "y"))
    assert dropped(line_dedup.dedup_lines(docs(spark, rows), range_bits=256, broadcast_bytes=0)) == brute(rows)


def test_ids_that_are_strings_and_null(spark):
    rows = [("a", "one line that all share"), ("b", "one line that all share\nand own text"), (None, "one line that all share"), (None, "one line that all share")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r["doc_id"], r["n_dropped"]) for r in got), key=repr) == [("a", 0), ("b", 1), (None, 1), (None, 1)]
    last = (1 << 63) - 1
    got = line_dedup.dedup_lines(spark.createDataFrame([(last, "one line that all share"), (None, "one line that all share")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_dropped"]) for r in got} == {(last, 0), (None, 1)}


def test_clashing_names_give_way(spark):
    x = docs(spark).selectExpr("*", "'mine' AS N_lines", "7 AS lb_key")
    got = line_dedup.dedup_lines(x)
    assert dropped(got) == brute(awkward()) and "N_lines" not in got.columns and {r["lb_key"] for r in got.collect()} == {7}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op3_line_dedup(spark, sf_dir), oracles.oracle_sql()["op3_line_dedup"], sf_dir)
