import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import oracles, queries, sharding
from tests.llm import fixtures
from tests.llm.sql import same_rows


def plain_jump(key, shards):
    """The published algorithm, in whole numbers of Python."""
    k = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 63, 64, 65, 1000])
def test_jumps_against_the_published_algorithm(spark, shards):
    df = spark.range(3000)
    got = [r.shard for r in df.select(sharding.jump(F.col("id"), shards)["shard"].alias("shard")).collect()]
    assert got == [plain_jump(k, shards) for k in range(3000)]


def test_rare_keys_with_many_jumps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 2)
    got = [r.shard for r in spark.range(500).select(sharding.jump(F.col("id"), 50)["shard"].alias("shard")).collect()]
    assert got == [plain_jump(k, 50) for k in range(500)]


def plain_rows(rows, shards=24):
    alike = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    out, full = [], {}
    for doc_id, size, crc in alike:
        s = plain_jump(doc_id, shards)
        out.append((doc_id, size, crc, "key", s, full.get(s, 0), plain_jump(doc_id, shards + 1)))
        full[s] = full.get(s, 0) + 1
    return out


COLUMNS = "doc_id size text_crc32 law shard slot grown_shard".split()


@pytest.mark.parametrize("repeats", [1, 40])
def test_query_on_awkward_documents(spark, tmp_path, repeats):
    """Repeated rows, a third of all with one id, lie in several ranges."""
    rows = fixtures.awkward() + [(1, "a document that is there often", "en", "s1", 3, None)] * repeats
    fixtures.docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_sharding(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_rows(rows), key=repr)


def test_empty_table(spark, tmp_path):
    fixtures.docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_sharding(spark, str(tmp_path)).count() == 0


def test_ranges_cut_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 100)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.sharded(df)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.sharded(df).exceptAll(got).count() == 0


def test_appending_moves_the_due_part_into_new_shards(spark):
    df = spark.range(40_000).withColumn("shard", F.lit("own"))
    for grown in (25, 30):
        x = sharding.moved(df, 24, grown, "id")
        assert x.filter("grown_shard < 24").count() == 0
        assert abs(x.count() / 40_000 - (1 - 24 / grown)) < 0.01
        assert x.select("id").exceptAll(df.select("id")).count() == 0
    sizes = [r["count"] for r in sharding.placed(df, 24, "id").groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 1.15 * 40_000 / 24


def test_written_shards(spark, tmp_path):
    docs = fixtures.docs(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.drop("shard").select(docs.columns).exceptAll(docs).count() == 0 and got.count() == docs.count()
    assert all(r.shard == plain_jump(r.doc_id, 5) for r in got.collect())


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op12_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_sql(spark, sf_dir):
    same_rows(queries.op12_sharding(spark, sf_dir), oracles.oracle_sql()["op12_sharding"], sf_dir)
