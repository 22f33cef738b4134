"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import duckdb
import pytest

from marginalia.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db(sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, db, name):
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
