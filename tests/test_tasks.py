"""No task holds a whole table: rows with texts are numbered by ranges, a map is in several files."""

import json

from marginalia.operators.ordering import numbered
from marginalia.queries import QUERIES, files
from marginalia.sources import large_json, pages


def test_long_texts_are_numbered_in_several_tasks(spark):
    x = spark.createDataFrame([(k * 37 % 101, "t" * 1000) for k in range(101)], "a int, t string")
    got = numbered(x, ("a",), "n", bytes_a_task=10_000)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert len(got.inputFiles()) > 5 and {(r["a"], r["n"]) for r in got.collect()} == {(k, k + 1) for k in range(101)}


def test_a_map_in_several_files(spark, tmp_path):
    entries = {f"d{k}": {"store_path": 'a"}, {\\' * (k % 4)} for k in range(40)}
    text = json.dumps({"before": {"x": 1}, "documents": entries, "after": {"d0": {}}}).encode()
    ends, at = [k + 1 for k in range(len(text)) if text[k] == 125][3::17], 0
    for n, end in enumerate([*ends, len(text)]):  # cut behind braces, in strings or out
        if end > at:
            (tmp_path / f"part-{n:05}.txt").write_bytes(text[at:end])
        at = end
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = [json.loads(r["value"]) for r in large_json.map_entries(spark, str(tmp_path), "documents").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == len(entries) and {k: v for f in found for k, v in f.items()} == entries


def test_the_map_is_written_by_several_tasks(spark, sf_dir, monkeypatch):
    paths, scratch = [], files.scratch
    monkeypatch.setattr(files, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["src5_one_map"](spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(paths[0]).inputFiles()) > 1


def test_files_of_few_pages_share_a_task(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"f{k}.txt").write_bytes(f"page of {k}\f".encode() * (200 if k == 7 else 3))
    rows = pages.page_rows(spark, str(tmp_path), files._FormFeeds(), "*.txt", task_pages=50)
    assert rows.rdd.getNumPartitions() == 4 + 1
    assert rows.count() == 59 * 3 + 200 and rows.filter("text <> concat('page of ', regexp_extract(path, 'f([0-9]+)', 1))").isEmpty()
