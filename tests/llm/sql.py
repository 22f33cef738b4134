import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def same_rows(df, sql, sf_dir):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted((tuple(map(_plain, r)) for r in found.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(map(_plain, r)) for r in df.select(*names).collect()), key=repr) == want
