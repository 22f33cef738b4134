import base64
import hashlib
import random
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marginalia.llm import base, bpe, packed, queries
from tests.llm.fixtures import SCHEMA, awkward, docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a  b", "a \n b  c", "　x \x1c y\x85z", "<|endoftext|> a", "q" * 5000, "#" * 700 + "ab" * 300, "it''s 's'S", "٣٤ १२ Ⅷ", "é ́", "\n\n \n a\t\tb  "]


def test_bpe_against_tiktoken(spark, reference):
    rows = awkward() + [(9000 + k, t, "en", "s", 0, None) for k, t in enumerate(ODD)]
    got = bpe.decode(bpe.encode(docs(spark, rows), PATH, P.PATTERN, bytes_col="again"), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == bytes(r["again"]) == (r["text"] or "").encode()
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0
    clash = bpe.encode(docs(spark, rows[:4]).selectExpr("*", "'mine' AS Ids"), PATH, P.PATTERN)
    assert clash.columns[-1] == "ids" and all(r["ids"] == reference.encode_ordinary(r["text"] or "") for r in clash.collect())


def test_bpe_forgets_without_harm(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Vocabulary(PATH, P.PATTERN)
    for k in range(6):
        texts = [f"word{k * 7 + j} other{j}" for j in range(40)]
        ids, ends = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [reference.encode_ordinary(t) for t in texts]


def test_bpe_of_long_pieces(reference):
    """Pieces of many windows, with and without tokens that windows share; four times the length takes about four times as long."""
    own, r, took = bpe.Vocabulary(PATH, P.PATTERN), random.Random(5), []
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [some("etaoin", 9000), some("日本語の", 3000), *("abcdefghijkl"[:k] * 4000 for k in range(1, 13)), "-" * 12_345, some("ab", 7000) + "x" * 5000]
    for t in texts:
        assert own.encode(pa.array([t]))[0].tolist() == reference.encode_ordinary(t), t[:20]
    for n in (1 << 15, 1 << 17):
        t = some("abcdefghijklmnopqrstuvwxyz", n)
        start = time.process_time()
        assert own.encode(pa.array([t]))[0].tolist() == reference.encode_ordinary(t)
        took.append(time.process_time() - start)
    assert took[1] <= 4 * 2 * took[0] + 0.5


MEMORY = """
import random, re
import public_tokenizers as P
import pyarrow as pa
from marginalia.llm import base, bpe
r, word = random.Random(3), lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
texts = [" ".join(word(r.randint(3, 12)) for _ in range(400)) for _ in range(1200)] + [word(1000) for _ in range(600)]
own = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
for b in base.sliced(iter([pa.record_batch({"text": texts})]), "text", bpe.BATCH_BYTES):
    ids, ends = own.encode(b.column("text"))
    assert own.decode(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))) == [t.encode() for t in b.column("text").to_pylist()]
said = open("/proc/self/status").read()
print((int(re.search(r"VmHWM:\\s+(\\d+)", said)[1]) - int(re.search(r"RssFile:\\s+(\\d+)", said)[1])) // 1024)
"""


def test_bpe_in_bounded_memory():
    """MB that a worker takes at most, mapped files apart, over texts of which no word comes again and long pieces."""
    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 310


def test_bpe_gets_batches_of_bounded_bytes(spark, reference):
    """Long texts come to a worker in several batches, not 10,000 rows at once."""
    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)

    long = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.repeat(F.lit("word and "), 100_000).alias("text"))
    corpus_pipeline.token_ids(spark, long.limit(0), "").count()
    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 40 and max(r["size"] for r in got) < 2 * base.ARROW_BYTES


def test_bpe_query(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 32])
def test_packed_file_round_trip(tmp_path, bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 150_000, dtype=np.uint64).astype("<u4")
    uri = f"file://{tmp_path}/x.tok"
    fs, path = pa.fs.FileSystem.from_uri(uri)
    w = packed.Writer(fs.open_output_stream(path), bits)
    for k in range(0, len(ids), 997):
        w.add(k, ids[k : k + 997])
    w.add(None, ids[:0])
    w.close()
    r = packed.Reader(uri)
    assert (tmp_path / "x.tok").stat().st_size < len(ids) * bits / 8 + 20_000
    for a, n in ((0, len(ids)), (65_535, 3), (131_072, 1), (77, 66_000), (149_999, 1), (4, 0)):
        assert (r.tokens(a, n) == ids[a : a + n]).all()
    assert r.nulls.tolist() == [False] * (len(r.ids) - 1) + [True] and r.starts[-1] == len(ids)


def test_packed_against_library(spark, tmp_path):
    rows = awkward() + [(9000 + k, t, "en", "s", 0, None) for k, t in enumerate(ODD)]
    path = P.path("word_bpe_49k.json")
    manifest = packed.write_tokens(docs(spark, rows), f"file://{tmp_path}", lambda: packed.word_encoder(path), packed.bits_for(49_408), end_id=1)
    got = packed.read_tokens(spark, manifest).orderBy(F.col("start")).collect()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want, start = {}, 0
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault(r[0], []).append(ids)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    for r in got:
        assert r["ids"] in want[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    none = packed.write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", lambda: packed.word_encoder(path), 16)
    assert packed.read_tokens(spark, none).count() == 0


def test_words_apart_as_the_library_has_them():
    own = packed.WordEncoder(P.path("word_bpe_49k.json"))
    r = random.Random(1)
    texts = ["".join(r.choice("aAbBéÉß.,'’…!1٣ \n\tİ́ıSst") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    ids, ends = own(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_packed_query(spark, sf_dir):
    got = queries.op8_packed_tokens(spark, sf_dir).orderBy("doc_id").collect()
    starts = [r["start"] for r in got]
    assert starts == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_packed_query_has_the_library_s_added_tokens(spark, tmp_path):
    """Against the library as it is, with no switch set."""
    texts = ["a <|endoftext|> b", "<|startoftext|>Word<|endoftext|>", "x<|endoftext|><|endoftext|>.Y, z", "<|ENDOFTEXT|> <|endoftext| > <|EndOfText|>", "é<|endoftext|>́a\n<|startoftext|>\t", "", None, "no literal. here"]
    docs(spark, [(k, t, "en", "s", 0, None) for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = queries.op8_packed_tokens(spark, str(tmp_path)).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_words_with_added_tokens_as_the_library_has_them():
    own, library = packed.WordEncoder(P.path("word_bpe_49k.json"), special=True), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    r = random.Random(2)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Ab", "é", ".", ",", "'s", " ", "\n", "́", "İ", "٣"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    ids, ends = own(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)
