"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

from marginalia.llm.quality import BOTH_SIDES, FINE, PRIOR, RATES, REACH, SMOOTH

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-6),
e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT doc_id, least(doc_id, (SELECT min(b) FROM e WHERE e.a = d.doc_id AND e.same)) AS copy_id FROM documents d)
SELECT d.doc_id, k.copy_id, least(d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id)) AS class_id,
       1 + (SELECT count(*) FROM e WHERE e.a = d.doc_id AND e.same) AS n_copies,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links,
       (SELECT count(DISTINCT x.copy_id) FROM e JOIN k x ON x.doc_id = e.b WHERE e.a = d.doc_id AND NOT e.same) AS n_text_links
FROM documents d JOIN k USING (doc_id)
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - caps::DOUBLE) / rest::DOUBLE AS level FROM r),
f AS (SELECT min_by(level, struct_pack(a := cap / weight, b := source IS NULL, c := coalesce(source, ''))) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * weight, cap::DOUBLE)) AS target FROM l),
q AS (
  SELECT d.doc_id, d.source, d.size, d.k, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, p, (done + p * source_size)::DOUBLE / nullif(target, 0) AS finish FROM q, (VALUES (0), (1)) AS v(p) WHERE size > 0),
g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, p, k, size ROWS UNBOUNDED PRECEDING) AS run FROM e),
n AS (SELECT doc_id, k, size, source, sum(size) FILTER (run <= 1.5 * (SELECT sum(source_size) FROM s) + 0.5) AS taken FROM g GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(n.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.size = n.size AND q.source IS NOT DISTINCT FROM n.source
"""

_LINES = r"""
WITH l AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (doc_id > f.first)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.first IS NULL OR doc_id <= f.first), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""

_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""

#: Where the level of a measure lies; the sketches' buckets are its whole numbers.
_LEVELS = {m: f"({count} + {SMOOTH[m]})::DOUBLE / nullif({n} + {SMOOTH[m]}, 0)" for m, (count, n) in RATES.items()}


def _quartiles(by: str) -> str:
    keys = f"{by}, measure" if by else "measure"
    return f"""SELECT {keys}, any_value(total) AS n, min(b) FILTER (upto >= 0.25 * total) AS low, min(b) FILTER (upto >= 0.75 * total) AS high FROM (
    SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, b, sum(c) AS c FROM h GROUP BY ALL)) GROUP BY ALL"""


def _drawn(x: str, to: str) -> str:
    return ", ".join(f"({x}.n::DOUBLE * {x}.{c} + {PRIOR} * {to}.{c}) / ({x}.n + {PRIOR}) AS {c}" for c in ("low", "high"))


def _due(m: str, side: str) -> str:
    return f"exp(f.{m}_{side} / {FINE}) * ({RATES[m][1]} + {SMOOTH[m]})"


_BEYOND = " OR ".join([f"{RATES[m][0]} + {SMOOTH[m]} > {_due(m, 'top')} + {REACH[m]} * sqrt({_due(m, 'top')} + 1)" for m in REACH] + [f"{RATES[m][0]} + {SMOOTH[m]} < {_due(m, 'bottom')} - {REACH[m]} * sqrt({_due(m, 'bottom')} + 1)" for m in BOTH_SIDES])
_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents) JOIN w USING (doc_id) LEFT JOIN c USING (doc_id)),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CASE WHEN n_words > 0 THEN {FINE} * ln({v}) END AS {m}" for m, v in _LEVELS.items())} FROM m),
h AS (SELECT lang, source, measure, ceil(v)::BIGINT AS b, count(*) AS c FROM (
  UNPIVOT (SELECT lang, source, {", ".join(REACH)} FROM x WHERE NOT base_failed) ON {", ".join(REACH)} INTO NAME measure VALUE v) GROUP BY ALL),
o AS ({_quartiles("lang, source")}), g AS ({_quartiles("lang")}), a AS ({_quartiles("")}),
gg AS (SELECT g.lang, measure, {_drawn("g", "a")} FROM g JOIN a USING (measure)),
oo AS (SELECT o.lang, o.source, o.measure, {_drawn("o", "gg")} FROM o JOIN gg ON o.measure = gg.measure AND o.lang IS NOT DISTINCT FROM gg.lang),
f AS (SELECT lang, source, {", ".join(f"max(high + {r} * (high - low)) FILTER (measure = '{m}') AS {m}_top" for m, r in REACH.items())},
  {", ".join(f"max(low - 1 - {REACH[m]} * (high - low)) FILTER (measure = '{m}') AS {m}_bottom" for m in BOTH_SIDES)} FROM oo GROUP BY lang, source)
SELECT x.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({_BEYOND}, false) AS kept
FROM x LEFT JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source
"""


def _nearest(book: str) -> str:
    """Of each part of each vector, distance and index of the nearest entry of a book."""
    return f"""SELECT n, p, min([list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k]) AS best
  FROM parts JOIN {book} USING (p) GROUP BY n, p"""


def _moved(book: str, near: str) -> str:
    """The book after a round: entries at floor(sum / count) of their parts, those without parts as before."""
    return f"""SELECT p, k, coalesce(z, y) AS y FROM {book} LEFT JOIN (
    SELECT p, k, list((s - (s % c + c) % c) // c ORDER BY i) AS z
    FROM (SELECT p, best[2] AS k, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM {near} JOIN parts USING (n, p), range(1, 5) t(i) GROUP BY ALL) GROUP BY p, k) USING (p, k)"""


#: Vectors of 64 dimensions.
_CODES = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT n, p, e[4 * p + 1:4 * p + 4] AS x FROM v, range(16) t(p)),
b0 AS (SELECT p, n - 1 AS k, x AS y FROM parts WHERE n <= 64),
n0 AS MATERIALIZED ({_nearest("b0")}), b1 AS MATERIALIZED ({_moved("b0", "n0")}),
n1 AS MATERIALIZED ({_nearest("b1")}), b2 AS MATERIALIZED ({_moved("b1", "n1")}),
n2 AS MATERIALIZED ({_nearest("b2")}),
c AS (SELECT n, lower(string_agg(printf('%02x', best[2]), '' ORDER BY p)) AS code, sum(best[1])::BIGINT AS error FROM n2 GROUP BY n)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM v JOIN c USING (n)
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, half a byte at a time; the table follows from the polynomial."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    half = lambda c, x: f"xor(({c}) >> 4, ({table}::BIGINT[])[(xor(({c}), ({x})) & 15) + 1])"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: {half(half('c', 'x'), 'x >> 4')}), 4294967295::BIGINT)"


_SHARDS = f"""
WITH RECURSIVE j(doc_id, state, shard, next) AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, s, next, floor((next + 1)::DOUBLE * (2147483648::DOUBLE / ((s >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM j WHERE next < 24)),
k AS (SELECT doc_id, shard, CASE WHEN next = 24 THEN 24 ELSE shard END AS grown_shard FROM j WHERE next >= 24),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents)
SELECT d.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""

_RUNS = f"""
WITH h AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM a),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
m AS (SELECT y.doc_id, y.i, z.i - y.i AS q FROM x y JOIN x z ON y.doc_id = z.doc_id AND y.word = z.word AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
         list(struct_pack(start, length, period) ORDER BY length::DOUBLE / period DESC, start, period)[1] AS best FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": _NEAR, "op2_mixing": _MIX, "op3_line_dedup": _LINES, "op5_quality_rules": _QUALITY, "op7_exact_top_k": _TOP, "op11_vector_codes": _CODES, "op12_sharding": _SHARDS, "op13_periodic_runs": _RUNS}
