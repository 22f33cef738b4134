"""Byte-level BPE: texts to token ids and back.

A partition's texts are cut into units (blanks, then what follows up to the next blank), of which most
repeat; only units not met lately are cut further, by the tokenizer's pattern, and encoded. That is a
recursive DuckDB query: every position's pair of adjacent tokens joins the merge table, and every round
contracts each piece's leftmost pair of least rank, until no piece has a pair left. Decoding joins token
rows with the vocabulary and aggregates the bytes in order. What is remembered is bounded.

A piece of thousands of letters takes as many rounds, so it is encoded in windows that overlap. Ids are
the encoding of their text exactly if each two neighbours are that of theirs; so where two windows have
a token in common, the one's ids up to it and the other's from it on are the ids of both together. Where
they have none, the text is encoded again from a border of the first.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marginalia.llm.base import cleared, row_schema, sliced, strung, tidy, units_of, with_columns

#: White space as Unicode has it; fixed values.
_ODD_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE = r"\t-\r\x20" + _ODD_SPACE
_UNIT = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD = re.compile(b"|".join(c.encode() for c in _ODD_SPACE))
#: Units that a worker remembers; those not met while half as many others came are forgotten.
REMEMBERED = 600_000
#: Bytes of text that are encoded together, unless one text has more.
BATCH_BYTES = 1 << 20
#: Rounds of one recursive query; longer pieces take several.
ROUNDS = 48
#: Bytes of the pieces of one recursive query, unless a single piece has more.
QUERY_BYTES = 1 << 18

#: A longer piece is encoded in windows that begin so many bytes apart, a number that the lengths of most repeating tokens divide.
STRIDE = 960
#: Bytes that a window shares with the next.
OVERLAP = 128

#: n counts the rounds, and is -1 in the row that a piece without a pair ends with.
_ENCODE = f"""
WITH RECURSIVE step(n, piece, toks) AS (
  SELECT 0, piece, toks FROM tokens
  UNION ALL
  SELECT CASE WHEN tok IS NULL THEN -1 ELSE n + 1 END, s.piece,
         CASE WHEN tok IS NULL THEN toks ELSE list_concat(toks[1:place - 1], [tok], toks[place + 2:len(toks)]) END
  FROM step s LEFT JOIN (
    SELECT piece, min((m.rank << 32) | place) AS best, best & 4294967295 AS place, (best >> 32)::INTEGER AS tok
    FROM (
      SELECT piece, place, (toks[place]::BIGINT << 20) | toks[place + 1] AS pair
      FROM (SELECT piece, toks, unnest(range(1, len(toks))) AS place FROM step WHERE n BETWEEN 0 AND {ROUNDS - 1}))
    JOIN merges m USING (pair) GROUP BY piece) b ON b.piece = s.piece
  WHERE n BETWEEN 0 AND {ROUNDS - 1})
SELECT piece, n, toks FROM step WHERE n IN (-1, {ROUNDS})
"""


_DECODE = "SELECT text, string_agg(hex, '' ORDER BY pos) FROM token_rows JOIN vocabulary USING (tok) GROUP BY text"


class Vocabulary:
    """A tiktoken-format rank file with its pattern, its merge table in DuckDB, and what was encoded."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]"))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        cuts = ((t[:k], t[k:], r) for t, r in self.ranks.items() for k in range(1, len(t)))
        pairs = np.fromiter((x for a, b, r in cuts if a in self.ranks and b in self.ranks for x in (self.ranks[a] << 20 | self.ranks[b], r)), np.int64).reshape(-1, 2)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("SET temp_directory = ''")
        self._fill("merges", pa.table({"pair": pairs[:, 0], "rank": pairs[:, 1]}))
        ids = sorted(self.ranks.items(), key=lambda x: x[1])
        self.sizes = np.zeros(ids[-1][1] + 1, np.int64)
        self.sizes[[r for _, r in ids]] = [len(t) for t, _ in ids]
        self._fill("vocabulary", pa.table({"tok": pa.array([r for _, r in ids], pa.int32()), "hex": [t.hex() for t, _ in ids]}))
        tidy()

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def pieces_of(self, unit: str) -> list[str]:
        """What the tokenizer's pattern finds. Letters after at most one space, and a stop after them, need no search."""
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():
            return [unit]
        if word[-1:] in {".", ","} and word[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def encode_pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, as little-endian 32-bit numbers. One that is in the vocabulary is its own token."""
        done = {p: self.ranks[p].to_bytes(4, "little") for p in pieces if p in self.ranks}
        todo = [p for p in pieces if p not in done]
        windows = {p: [p[k : k + STRIDE + OVERLAP] for k in range(0, max(1, len(p) - OVERLAP), STRIDE)] for p in todo if len(p) > STRIDE + OVERLAP}
        found = self._contracted({p for p in todo if p not in windows} | {w for ws in windows.values() for w in ws})
        for p in todo:
            done[p] = self._joined(p, [found[w] for w in windows[p]]) if p in windows else found[p]
        return done

    def _ends(self, ids: bytes, start: int) -> list[int]:
        """Where the tokens of a window that begins at start end."""
        return (start + np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])).tolist()

    def _joined(self, piece: bytes, parts: list[bytes]) -> bytes:
        """Ids of a piece from those of its windows."""
        ids, ends = parts[0], self._ends(parts[0], 0)
        for k, part in enumerate(parts[1:], 1):
            start, stop = k * STRIDE, min(len(piece), (k + 1) * STRIDE + OVERLAP)
            back = OVERLAP
            while True:
                first = bisect.bisect_left(ends, start)  # a token of the window begins where one before ends, if at all
                own = self._ends(part, start)
                borders = {start: 0} | {e: j + 1 for j, e in enumerate(own[:-1])}
                met = next(((i, j) for i in range(first, len(ends) - 1) if (j := borders.get(ends[i])) is not None and own[j] == ends[i + 1]), None)
                if met:
                    break
                back *= 2  # nothing in common: the window is encoded anew from a border before it
                start = ends[max(0, bisect.bisect_left(ends, ends[-1] - back) - 1)] if back < ends[-1] else 0
                part = self._contracted({piece[start:stop]})[piece[start:stop]]
                if start == 0:
                    met = -1, 0
                    own = self._ends(part, 0)
                    break
            i, j = met
            ids, ends = ids[: 4 * (i + 1)] + part[4 * j :], ends[: i + 1] + own[j:]
        return ids

    def _contracted(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece by the recursive query."""
        done = {}
        todo = sorted(pieces, key=len)
        start = 0
        while start < len(todo):
            stop, total = start, 0
            while stop < len(todo) and (stop == start or total + len(todo[stop]) <= QUERY_BYTES):
                total += len(todo[stop])
                stop += 1
            part = todo[start:stop]
            keys = np.arange(len(part))
            toks = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), pa.array(self.byte[np.frombuffer(b"".join(part), np.uint8)]))
            while len(keys):
                self._fill("tokens", pa.table({"piece": keys, "toks": toks}))
                got = self.db.sql(_ENCODE).to_arrow_table().combine_chunks()
                keys, toks = got.column("piece").to_numpy(), got.column("toks").combine_chunks()
                flat, ends = toks.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum([0, *toks.value_lengths().to_pylist()]) * 4
                again = got.column("n").to_numpy() >= ROUNDS
                for k, a, b, more in zip(keys.tolist(), ends[:-1].tolist(), ends[1:].tolist(), again.tolist(), strict=True):
                    if not more:
                        done[part[k]] = flat[a:b]
                keys, toks = keys[again], toks.filter(pa.array(again))
            start = stop
        return done

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit, as little-endian 32-bit numbers."""
        if len(self.units) > REMEMBERED // 2:
            self.older, self.units = self.units, {}
        own, older = self.units, self.older
        fresh = set(units).difference(own)
        back = fresh.intersection(older)
        own.update((u, older[u]) for u in back)
        fresh -= back
        cut = [[p.encode() for p in self.pieces_of(u.decode())] for u in fresh]
        known = self.encode_pieces({p for ps in cut for p in ps})
        for u, ps in zip(fresh, cut, strict=True):
            own[u] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
        return [own[u] for u in units]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and where each text's end (0 first)."""
        codes, units, ends = units_of(texts)
        if any(map(_ODD.search, units)):  # white space that is no blank may join with blanks of the next unit
            cut = [_UNIT.findall(t or "") for t in texts.to_pylist()]
            units = list(dict.fromkeys(u for us in cut for u in us))
            place = {u: k for k, u in enumerate(units)}
            codes, ends = np.array([place[u] for us in cut for u in us], np.int64), np.cumsum([len(us) for us in cut])
            units = [u.encode() for u in units]
        return strung(codes, self.encode_units(units), ends)

    def decode(self, lists: pa.Array) -> list[bytes]:
        """The bytes of each list of ids: token rows, joined with the vocabulary, aggregated in order."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.db.register("token_rows", pa.table({
            "text": np.repeat(np.arange(len(lists), dtype="i4"), sizes), "pos": np.arange(len(flat), dtype="i4"), "tok": flat.astype("i4")}))
        rows = self.db.execute(_DECODE).fetchall()
        self.db.unregister("token_rows")
        out = [b""] * len(lists)
        for k, x in rows:
            out[k] = bytes.fromhex(x)
        return out


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """docs with the token ids of the whole text; an empty list for a null or empty one.

    With bytes_col, a new name, the ids are decoded again in the same pass, as decode does. path is a
    file every executor can open, such as one of an installed package. Special tokens are never
    produced. All rows and columns stay, but columns called ids_col or bytes_col, which give way.
    """
    docs, _ = cleared(docs, [ids_col, *([bytes_col] if bytes_col else [])], (text_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in sliced(batches, text_col, BATCH_BYTES):
            ids, ends = own.encode(batch.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            more = {bytes_col: pa.array(own.decode(lists), pa.binary())} if bytes_col else {}
            yield with_columns(batch, **{ids_col: lists}, **more)

    return docs.mapInArrow(run, row_schema(docs, f"`{ids_col}` array<int>" + (f", `{bytes_col}` binary" if bytes_col else "")))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with the bytes of the token ids; empty for a null or empty list. A column called bytes_col gives way."""
    docs, _ = cleared(docs, (bytes_col,), (ids_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            sizes = batch.column(ids_col).value_lengths().fill_null(0).to_pylist()
            at, total = 0, 0
            for i, n in [*enumerate(sizes), (len(sizes), 1 << 62)]:
                if i > at and total + n > 1 << 20:
                    part = batch.slice(at, i - at)
                    yield with_columns(part, **{bytes_col: pa.array(own.decode(part.column(ids_col)), pa.binary())})
                    at, total = i, 0
                total += n

    return docs.mapInArrow(run, row_schema(docs, f"`{bytes_col}` binary"))
