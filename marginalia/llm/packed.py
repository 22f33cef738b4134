"""Token ids of a corpus as packed binary files.

A file holds documents in ascending order of id:

    magic        8 bytes
    blocks       the ids of all its documents, one after another, BLOCK ids a block, each id in the
                 least number of bits that the vocabulary needs, low bits first; a block begins at a byte
    documents    two 64-bit little-endian arrays: ids of documents (0 for a null id), and the place of
                 each one's first token, with the number of tokens at the end; then a byte a document
                 that is 1 for a null id
    offsets      64-bit: the byte at which each block begins, with the end of the last
    footer       JSON with the counts, then its length in 4 bytes and the magic again

With the offsets any run of tokens is read without what comes before, and a block is unpacked by
numpy as a whole. Tasks write under names of their own and only the names of tasks that succeeded
are in the manifest, so a task that is tried again leaves nothing half written in sight.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.base import BLANKS, sliced, strung, units_of

#: What often stands after a word.
STOPS = (b".", b",")
MAGIC = b"MGTOKEN1"
BLOCK = 1 << 16
#: Words whose ids a worker remembers; those not met while half as many others came are forgotten.
REMEMBERED = 1_500_000


def bits_for(vocab_size: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (uint32) in so many bits each, low bits first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first_bit: int = 0) -> np.ndarray:
    """n ids from packed data, the first of which begins at this bit."""
    if bits % 8 == 0:
        width = bits // 8
        raw = np.frombuffer(data, np.uint8, n * width, first_bit // 8).reshape(n, width)
        out = np.zeros((n, 4), np.uint8)
        out[:, :width] = raw
        return out.view("<u4").ravel()
    at = first_bit + np.arange(n, dtype=np.int64) * bits
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    value = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes one file, holding one block and the table of documents."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.stream.write(MAGIC)
        self.at, self.held, self.n_held, self.n = len(MAGIC), [], 0, 0
        self.offsets, self.ids, self.nulls, self.starts = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= BLOCK:
            whole = np.concatenate(self.held)
            for k in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._block(whole[k : k + BLOCK])
            rest = whole[len(whole) // BLOCK * BLOCK :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs_at = self.at
        tail = np.array(self.ids, "<i8").tobytes() + np.array([*self.starts, self.n], "<i8").tobytes() + bytes(self.nulls)
        offsets_at = docs_at + len(tail)
        tail += np.array([*self.offsets, docs_at], "<i8").tobytes()
        footer = json.dumps({"bits": self.bits, "docs": len(self.ids), "tokens": self.n, "block": BLOCK, "docs_at": docs_at, "offsets_at": offsets_at}).encode()
        self.stream.write(tail + footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(12, size - 12)
        if end[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file, or is cut off")
        n = int.from_bytes(end[:4], "little")
        self.about = json.loads(self.file.read_at(n, size - 12 - n))
        docs = self.about["docs"]
        table = self.file.read_at(17 * docs + 8, self.about["docs_at"])
        self.ids = np.frombuffer(table, "<i8", docs)
        self.starts = np.frombuffer(table, "<i8", docs + 1, 8 * docs)
        self.nulls = np.frombuffer(table, bool, docs, 16 * docs + 8)
        blocks = -(-self.about["tokens"] // self.about["block"])
        self.offsets = np.frombuffer(self.file.read_at(8 * (blocks + 1), self.about["offsets_at"]), "<i8")

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on."""
        if n <= 0:
            return np.zeros(0, "<u4")
        size, bits = self.about["block"], self.about["bits"]
        first, last = start // size, (start + n - 1) // size
        out = []
        for b in range(first, last + 1):
            low, high = max(start, b * size) - b * size, min(start + n, (b + 1) * size) - b * size
            a, z = low * bits // 8, -(-high * bits // 8)
            data = self.file.read_at(z - a, int(self.offsets[b]) + a)
            out.append(unpack(data, bits, high - low, low * bits - a * 8))
        return np.concatenate(out)


class WordEncoder:
    """A tokenizer of the tokenizers library that encodes between blanks: texts are cut at them, and words met before are looked up.

    With special, the literals of the tokenizer's added tokens are those tokens, as in the library by default; else they are text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are in lower case here, where a literal is found that the text does not have
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(rf"[{BLANKS}]", t.content) for t in added.values()):
            raise ValueError(f"{path} has added tokens that are more than literals")
        self.added = {t.content.encode(): np.array([k], "<u4").tobytes() for k, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.literal = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.words: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and where each text's end (0 first)."""
        codes, units, ends = units_of(texts)
        blanks = BLANKS.encode()
        cut = {k: self.literal.split(u.strip(blanks)) for k, u in enumerate(units) if self.literal.search(u)} if self.literal and self.literal.search(b"".join(units)) else {}
        words = (u.strip(blanks).lower() for u in units)
        parts = [self.parts(w) if w.endswith(STOPS) else (w, b"") for w in words]
        for k in cut:
            parts[k] = b"", b""
        words = {w for w, _ in parts}
        words.update(STOPS)
        words.update(w.lower() for pieces in cut.values() for w in pieces[::2])
        if len(self.words) > REMEMBERED // 2:
            self.older, self.words = self.words, {b"": b""}
        own, older = self.words, self.older
        fresh = words.difference(own)
        back = fresh.intersection(older)
        own.update((w, older[w]) for w in back)
        new = list(fresh - back)
        lists = [[w.decode() for w in new[k : k + 500]] for k in range(0, len(new), 500)]
        for k, e in enumerate(self.tokenizer.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)):
            raw, at = np.array(e.ids, "<u4").tobytes(), 0
            for w, end in zip(new[500 * k : 500 * k + 500], (np.cumsum(np.bincount(np.array(e.word_ids, int), minlength=len(lists[k]))) * 4).tolist(), strict=True):
                own[w], at = raw[at:end], end
        found = [own[a] + own[b] if b else own[a] for a, b in parts]
        for k, pieces in cut.items():
            found[k] = b"".join(self.added[w] if i % 2 else own[w.lower()] for i, w in enumerate(pieces))
        return strung(codes, found, ends)

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes]:
        """A word that ends in a stop as the two, which the tokenizer takes apart anyway if a letter or digit is before it.

        A-Z are in lower case already, as the tokenizer would make them. A letter whose lower case ends
        in a mark is left with the stop, because the two make one piece.
        """
        if len(word) > 1:
            before = word[-2:-1]
            if before.isalnum() or (before >= b"\x80" and word[:-1].decode()[-1].lower()[-1].isalpha()):
                return word[:-1], word[-1:]
        return word, b""


@cache
def word_encoder(path: str, special: bool = False) -> WordEncoder:
    return WordEncoder(path, special)


def write_tokens(
    docs: DataFrame, out_uri: str, encoder: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]], bits: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> list[dict]:
    """Writes docs in ascending order of id and returns the manifest: of each file shard, uri, docs, tokens, start.

    encoder() gives, in a worker, the function from texts to ids, all in one array, and their ends. out_uri is a folder that all
    executors share. A null id comes first; rows of one id follow by a hash of the text, then by text. A null or
    empty text has only the end id. An empty table writes nothing. Ids are 64-bit integers.
    """
    run = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([] if end_id is None else [end_id], "<u4")
        encode, writer, shard, uri = encoder(), None, None, ""
        for batch in sliced(batches, "text"):
            if writer is None:
                shard = batch.column("shard")[0].as_py()
                uri = f"{out_uri}/{run}-{shard:06d}-{uuid.uuid4().hex[:8]}.tok"
                fs, path = pa.fs.FileSystem.from_uri(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                writer = Writer(fs.open_output_stream(path), bits)
            ids, ends = encode(batch.column("text"))
            for doc_id, a, z in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                writer.add(doc_id, np.concatenate([ids[a:z], end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "docs": [len(writer.ids)], "tokens": [writer.n]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").drop("tie").withColumn("shard", F.spark_partition_id().cast("long"))
    )
    files = sorted((r.asDict() for r in ordered.mapInArrow(write, "shard bigint, uri string, docs bigint, tokens bigint").collect()), key=lambda r: r["shard"])
    start = 0
    for f in files:
        f["start"], start = start, start + f["tokens"]
    return files


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """A row a document, read from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file = Reader(f["uri"])
                docs = len(file.ids)
                a = 0
                while a < docs:
                    b = max(a + 1, int(np.searchsorted(file.starts, file.starts[a] + (1 << 20), "right")) - 1)
                    ids = file.tokens(int(file.starts[a]), int(file.starts[b] - file.starts[a]))
                    cuts = file.starts[a : b + 1] - file.starts[a]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.ids[a:b], mask=file.nulls[a:b]), pa.array(f["start"] + file.starts[a:b]), pa.array(np.diff(cuts)),
                        pa.array([zlib.crc32(ids[p:q].tobytes()) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view("<i4"))),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    a = b

    files = spark.createDataFrame(manifest, "shard bigint, uri string, docs bigint, tokens bigint, start bigint").repartitionByRange(max(1, len(manifest)), "shard")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
