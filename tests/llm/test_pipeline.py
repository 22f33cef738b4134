import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.fixtures import docs
from tests.llm.test_near_dup import brute as near_brute


def test_stages(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [source]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for before, after in zip(seen[:-2], seen[1:-1], strict=True):
        assert after.columns == source.columns and after.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    lines, alone, mixed, last = seen[2].collect(), seen[3].collect(), seen[4].collect(), seen[5].collect()
    groups = {x[0]: x[1] for x in near_brute([(r["doc_id"], r["text"]) for r in lines])}
    assert {r["doc_id"] for r in alone} == {i for i, g in groups.items() if i == g}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(last) == len(mixed)
    assert all(r["decodes"] and r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) for r in last)


def test_run_and_awkward_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    rows = docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    rows.count()
