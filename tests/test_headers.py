"""Lines that begin with decimals but are no headers, against the SQL."""

import duckdb
import pytest

from marginalia.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["txt4_split_sections", "agg13_merge_titles", "txt6_chunks"])
def test_an_address_begins_no_section(spark, tmp_path, name):
    words = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    texts = [
        f"56.187.231.175 {words(90, 'a')}.\n{words(30, 'b')}\n{words(20, 'c')}",
        f"{words(40, 'a')}\n{words(30, 'b')}\n42.97.92.12 {words(30, 'c')}\n{words(20, 'd')}\n3.5 {words(20, 'e')}\n{words(12, 'f')}\nTable 2 {words(9, 'g')}",
    ]
    values = ", ".join(f"({k}, '{t}')" for k, t in enumerate(texts))
    with duckdb.connect() as c:
        c.execute(f"CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, 'en' AS lang, 's' AS source FROM (VALUES {values}) AS v(doc_id, text)")
        c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
        found = c.execute(SQL[name])
        names, want = [d[0] for d in found.description], sorted(found.fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=repr) == want and want
