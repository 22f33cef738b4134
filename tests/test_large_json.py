"""Entries of one JSON map read in byte ranges, against a JSON parser."""

import json
import random

import pytest

from marginalia.sources import large_json, readers


def awkward(n, seed=1):
    r = random.Random(seed)
    bits = ['"', "\\", "}", "{", ",", ":", "[", "]", " ", "é", "语", '"documents": {', "x", "\n", "\\\\\"", "}, {"]
    some = lambda: "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))
    value = lambda: {"store_path": some(), "total_pages": r.randrange(9), "more": {"a": [some(), {"b": some()}]}, "unit_title": some()}
    return {f"d{k}{some()}": value() for k in range(n)}


@pytest.mark.parametrize("split", [200, 1000, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_against_a_parser(spark, tmp_path, split, indent):
    """Splits of some hundred bytes begin in strings, between entries and inside of them."""
    entries = awkward(120)
    whole = {"before": {"documents": {"no": {"store_path": "no"}}, "x": 1}, "list": [{"documents": {"neither": {}}}], "documents": entries, "n": 3, "after": {"z": {"store_path": "no"}}}
    (tmp_path / "m.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=split == 200))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = [json.loads(r["value"]) for r in large_json.map_entries(spark, str(tmp_path / "m.json"), "documents").collect()]
        got = readers.master_index(spark, str(tmp_path / "m.json")).select("document_id", "store_path", "total_pages", "unit_title").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(len(f) == 1 for f in found) and len(found) == len(entries) and {k: v for f in found for k, v in f.items()} == entries
    assert {tuple(r) for r in got} == {(k, v["store_path"], v["total_pages"], v["unit_title"]) for k, v in entries.items()}


@pytest.mark.parametrize("whole", [{"documents": {}}, {"other": {"a": {}}}, {"documents": {"a": {"store_path": "p"}}}])
def test_small_maps(spark, tmp_path, whole):
    (tmp_path / "m.json").write_text(json.dumps(whole))
    assert {r["document_id"] for r in readers.master_index(spark, str(tmp_path / "m.json")).collect()} == set(whole.get("documents", {}))
