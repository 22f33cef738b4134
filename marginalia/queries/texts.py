"""Queries of text functions over the documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as t
from marginalia.operators import chunking, parsing
from marginalia.queries.registry import clean_page_sql, fingerprint, query, sanitize_sql, strip_sql, words


def _d(tables, *columns):
    return tables.documents.select("doc_id", *columns)


@query("r3_word_count", f"SELECT doc_id, {words('text')} AS n FROM documents")
def _(x):
    return _d(x, t.word_count("text").alias("n"))


_DIRTY = "chr(7) || text || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(9) || ' x' || chr(8203) || chr(13) || 'y '"


@query("txt1_sanitize", f"SELECT doc_id, md5({sanitize_sql(_DIRTY)}) AS h FROM documents")
def _(x):
    return _d(x, fingerprint(t.sanitize(F.concat(F.lit("\x07"), "text", F.lit("\r\n\r\n\n\t x\u200b\ry ")))).alias("h"))


_NOISE = "\n 12 \nReprint 2024-25\n..........x\nThe Big Long Heading\nNot to be republished\n7"


@query("txt2_clean_page", f"SELECT doc_id, md5({clean_page_sql(f"text || '{_NOISE}'")}) AS h FROM documents")
def _(x):
    return _d(x, fingerprint(t.clean_page(F.concat("text", F.lit(_NOISE)))).alias("h"))


@query("flt8_garbage_page", r"""
SELECT doc_id, length(text) < 50 OR length(regexp_replace(text, '[\x20-\x7E\s\x{0900}-\x{097F}]', '', 'g'))::DOUBLE / length(text) > 0.1 AS garbage FROM documents""")
def _(x):
    return _d(x, t.is_garbage("text").alias("garbage"))


_MIXED = "CASE WHEN doc_id % 5 = 0 THEN 'नमस्ते' WHEN doc_id % 5 = 1 THEN 'नमस्ते ' || text WHEN doc_id % 5 = 2 THEN '123' ELSE text END"


@query("txt13_language", rf"""
SELECT doc_id, CASE WHEN d THEN 'hi' WHEN l THEN 'en' ELSE 'unknown' END AS lang_1, CASE WHEN d AND l THEN 'hien' WHEN d THEN 'hi' WHEN l THEN 'en' ELSE 'unknown' END AS lang_2
FROM (SELECT doc_id, regexp_matches(m, '[\x{{0900}}-\x{{097F}}]') AS d, regexp_matches(m, '[A-Za-z]') AS l FROM (SELECT doc_id, {_MIXED} AS m FROM documents))""")
def _(x):
    n = F.col("doc_id") % 5
    m = F.when(n == 0, "नमस्ते").when(n == 1, F.concat(F.lit("नमस्ते "), "text")).when(n == 2, "123").otherwise(F.col("text"))
    return _d(x, t.language(m).alias("lang_1"), t.language_mixed(m).alias("lang_2"))


# Labels ----------------------------------------------------------------------------------------

_PATH_SQL = r"'rag_store_x/egyankosh/' || CASE page_id % 4 WHEN 0 THEN 'Course ' || (page_id % 9) || '/BLOCK ' || (page_id % 13) WHEN 1 THEN 'Course A/Unit' WHEN 2 THEN 'BLOCK 7' ELSE 'my block/sub' END || '/' || regexp_replace(url, '^https?://', '')"


def _path():
    n = F.col("page_id")
    head = F.when(n % 4 == 0, F.concat(F.lit("Course "), (n % 9).cast("string"), F.lit("/BLOCK "), (n % 13).cast("string"))).when(n % 4 == 1, "Course A/Unit").when(n % 4 == 2, "BLOCK 7").otherwise("my block/sub")
    return F.concat(F.lit("rag_store_x/egyankosh/"), head, F.lit("/"), F.regexp_replace("url", "^https?://", ""))


@query("prj1_subject_block", rf"""
SELECT page_id, coalesce(CASE WHEN b > 1 AND NOT starts_with(lower(p[b - 1]), 'rag_store') THEN p[b - 1] END, CASE WHEN len(p) >= 2 THEN p[len(p) - 1] END) AS subject, CASE WHEN b > 0 THEN p[b] END AS block
FROM (SELECT page_id, p, coalesce(list_position(list_transform(p, lambda x: regexp_matches(x, '(?i)\bblock\b')), true), 0) AS b
      FROM (SELECT page_id, list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> '' AND lower(x) <> 'egyankosh') AS p FROM pages))""")
def _(x):
    return x.pages.select("page_id", t.subject_and_block(_path()).alias("s")).select("page_id", "s.subject", "s.block")


@query("prj2_block_in_text", r"""
SELECT doc_id, CASE WHEN l <> '' AND NOT list_contains(['here', 'there', 'this', 'that', 'the', 'a', 'an', 'of', 'for', 'to', 'in'], lower(string_split(l, ' ')[1])) THEN 'Block ' || l END AS label
FROM (SELECT doc_id, trim(string_split(regexp_replace(regexp_extract(trim(regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'x Block: 12 ' WHEN 1 THEN 'block the ' WHEN 2 THEN 'BLOCK two Unit ' ELSE '' END || regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')),
  '(?i)\bblock\b[\s:\-]*([a-z0-9]+(?:[\s\-]+[a-z0-9]+){0,6})\b', 1), '(?i)\b(?:unit|chapter|structure|objectives|introduction)\b', chr(1), 'g'), chr(1))[1]) AS l FROM documents)""")
def _(x):
    n = F.col("doc_id") % 4
    head = F.when(n == 0, "x Block: 12 ").when(n == 1, "block the ").when(n == 2, "BLOCK two Unit ").otherwise("")
    return _d(x, t.block_in_text(F.concat(head, F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("label"))


@query("prj3_block_label", r"""
SELECT doc_id, CASE WHEN best = '' THEN 'BLOCK UNSPECIFIED' ELSE 'BLOCK ' || left(trim(regexp_replace(regexp_replace(best, '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), 120) END AS label
FROM (SELECT doc_id, CASE WHEN b = 'INTRODUCTION' AND n <> '' THEN n ELSE b END AS best FROM (
  SELECT doc_id, CASE WHEN length(lt) > length(lf) THEN lt ELSE lf END AS b, regexp_extract(f, '\bBLOCK\s*(\d+|[IVX]+)\b', 1) AS n FROM (
    SELECT doc_id, f, trim(regexp_extract(f, p, 1)) AS lf, trim(regexp_extract(g, p, 1)) AS lt FROM (
      SELECT doc_id, '\bBLOCK\s*([\w\s:,-]{1,100}?)(?:\b(?:UNIT|CHAPTER|STRUCTURE|OBJECTIVES|INTRODUCTION|P\d)\b|$)' AS p,
             trim(regexp_replace(upper(regexp_replace('my_block-' || (doc_id % 20), '[_\-]+', ' ', 'g')), '\s+', ' ', 'g')) AS f,
             upper(regexp_replace(left(CASE doc_id % 3 WHEN 0 THEN 'Block 4 Poems of ' || source || ' Unit 1 ' WHEN 1 THEN 'BLOCK 99 ' ELSE 'none ' END, 6000), '\s+', ' ', 'g')) AS g FROM documents))))""")
def _(x):
    n = F.col("doc_id")
    body = F.when(n % 3 == 0, F.concat(F.lit("Block 4 Poems of "), "source", F.lit(" Unit 1 "))).when(n % 3 == 1, "BLOCK 99 ").otherwise("none ")
    return x.documents.select("doc_id", t.block_label(F.concat(F.lit("my_block-"), (n % 20).cast("string")), body).alias("label"))


@query("prj4_block_number", r"""
SELECT doc_id, coalesce('Block ' || try_cast(regexp_extract(s, '(?i)block\s*(\d+)', 1) AS BIGINT), s) AS label
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a Block 0' || (doc_id % 12) WHEN 1 THEN 'BLOCK' || (doc_id % 7) ELSE 'file ' || doc_id END AS s FROM documents)""")
def _(x):
    n = F.col("doc_id")
    stem = F.when(n % 3 == 0, F.concat(F.lit("a Block 0"), (n % 12).cast("string"))).when(n % 3 == 1, F.concat(F.lit("BLOCK"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("file "), n.cast("string")))
    return _d(x, t.block_number(F.concat(F.lit("some/folder/"), stem, F.lit(".pdf"))).alias("label"))


@query("prj5_safe_segment", r"""
SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace('<' || text || '?', '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), 120), ''), 'UNSPECIFIED') AS segment FROM documents""")
def _(x):
    return _d(x, t.safe_segment(F.concat(F.lit("<"), "text", F.lit("?"))).alias("segment"))


@query("prj6_document_id", r"""
SELECT doc_id, 'Unit-' || coalesce(nullif(left(replace(trim(regexp_replace(regexp_replace('Block 3 ' || source || ' notes ' || (doc_id % 10), '(?i)\bblock\s*[A-Za-z0-9-]+', '', 'g'), '\s+', ' ', 'g')), ' ', '_'), 120), ''), 'UNSPECIFIED')
  || '_' || left(md5('/x/' || doc_id || '.pdf'), 8) AS document_id FROM documents""")
def _(x):
    return _d(x, t.document_id(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".pdf")), F.concat(F.lit("Block 3 "), "source", F.lit(" notes "), (F.col("doc_id") % 10).cast("string"))).alias("document_id"))


@query("prj8_search_text", "SELECT page_id, lower(page_id || ' ' || url) AS search_text FROM pages")
def _(x):
    return x.pages.select("page_id", t.search_text(F.col("page_id").cast("string"), "url").alias("search_text"))


@query("prj9_embedding_input", "SELECT doc_id, md5(source || ': ' || left(text, 1000)) AS h FROM documents")
def _(x):
    return _d(x, fingerprint(t.embedding_input("source", "text")).alias("h"))


@query("src12_safe_path", "SELECT page_id, contains(p, '..') OR starts_with(p, '/') AS unsafe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '../' ELSE '' END || regexp_replace(url, '^https?:/', '') AS p FROM pages)")
def _(x):
    n = F.col("page_id") % 3
    return x.pages.select("page_id", t.unsafe_path(F.concat(F.when(n == 0, "/").when(n == 1, "../").otherwise(""), F.regexp_replace("url", "^https?:/", ""))).alias("unsafe"))


# Citations, model output -----------------------------------------------------------------------

_CITED_SQL = "'To be (p. 12) or (20) not ' || text || CASE doc_id % 4 WHEN 0 THEN ' (Canto II, 4)' WHEN 1 THEN ' p. 77 ' WHEN 2 THEN ' (nothing)' ELSE '' END"


def _cited():
    n = F.col("doc_id") % 4
    return F.concat(F.lit("To be (p. 12) or (20) not "), F.col("text"), F.when(n == 0, " (Canto II, 4)").when(n == 1, " p. 77 ").when(n == 2, " (nothing)").otherwise(""))


@query("txt8_strip_citations", rf"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_CITED_SQL}, '(?i)\s*\((?:[^)]*\b(?:p\.?|pp\.?|page|pg|Prologue|Chapter|Canto|Book)\b[^)]*)\)', '', 'g'), '\s*\(\s*\d{{1,4}}\s*\)', '', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents""")
def _(x):
    return _d(x, fingerprint(t.strip_citations(_cited())).alias("h"))


@query("txt9_locator", rf"""
SELECT doc_id, md5(coalesce(nullif(trim(regexp_extract(c, '(?i)\(([^)]*(?:\b(?:p\.?|pp\.?|page|pg|canto|book|prologue)\b)[^)]*)\)', 1)), ''), nullif(regexp_extract(c, '\b[pP]\.\s*(\d{{1,4}})\b', 1), ''))) AS h
FROM (SELECT doc_id, regexp_replace({_CITED_SQL}, '^To be \(p\. 12\)', '') AS c FROM documents)""")
def _(x):
    return _d(x, fingerprint(t.locator(F.regexp_replace(_cited(), r"^To be \(p\. 12\)", ""))).alias("h"))


@query("txt10_first_words", rf"""
SELECT doc_id, md5({strip_sql('h')}) AS h, length(h)::INTEGER AS stop FROM (SELECT doc_id, regexp_extract(text, '^\s*(?:\S+\s+){{0,209}}\S+') AS h FROM documents)""")
def _(x):
    return _d(x, t.first_words("text").alias("w")).select("doc_id", fingerprint(F.col("w.text")).alias("h"), F.col("w.end").alias("stop"))


_Q_SQL = "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'A) x' || chr(10) || ' b. y' || chr(10) || 'C: z' || chr(10) || 'D- w' WHEN doc_id % 3 = 1 THEN chr(10) || 'Is it true?' || chr(10) || 'A) only' ELSE '' END"


def _question():
    n = F.col("doc_id") % 3
    return F.concat("text", F.when(n == 0, "\nA) x\n b. y\nC: z\nD- w").when(n == 1, "\nIs it true?\nA) only").otherwise(""))


@query("txt14_option_markers", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(q, '(?im)^\s*{m}\s*[).:\-]') THEN '{m}' END" for m in "ABCD") + f"], lambda x: x IS NOT NULL), '') AS markers FROM (SELECT doc_id, {_Q_SQL} AS q FROM documents)")
def _(x):
    return _d(x, F.array_join(t.option_markers(_question()), "").alias("markers"))


@query("txt15_type_match", rf"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN o WHEN 1 THEN NOT o AND NOT f WHEN 2 THEN false ELSE f END AS type_match
FROM (SELECT doc_id, regexp_matches(q, '(?i)\b(true|false)\b') AS f, {' AND '.join(rf"regexp_matches(q, '(?im)^\s*{m}\s*[).:\-]')" for m in 'ABCD')} AS o FROM (SELECT doc_id, {strip_sql(_Q_SQL)} AS q FROM documents))""")
def _(x):
    kind = F.get(F.array(*[F.lit(k) for k in t.QUESTION_TYPES]), (F.col("doc_id") % 4).cast("int"))
    return _d(x, t.type_match(kind, _question())["type_match"].alias("type_match"))


@query("txt16_latex", r"""
SELECT doc_id, replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '\\frac\{([^}]+)\}\{([^}]+)\}', '(\1/\2)', 'g'),
  '\cdot', '×'), '\times', '×'), '\Delta', 'Δ'), '\neq', '≠'), '\leq', '≤'), '\geq', '≥'), '\\text\{([^}]+)\}', '\1', 'g'), '$', '') AS plain
FROM (SELECT doc_id, '$\frac{a}{b' || doc_id || '} \cdot \text{' || source || '} \leq \Delta$' AS t FROM documents)""")
def _(x):
    return _d(x, t.latex_to_text(F.concat(F.lit(r"$\frac{a}{b"), F.col("doc_id").cast("string"), F.lit(r"} \cdot \text{"), "source", F.lit(r"} \leq \Delta$"))).alias("plain"))


@query("txt17_split_citation", rf"""
SELECT doc_id, md5(CASE WHEN has THEN {strip_sql("regexp_replace(a, '(?ims)^Citation:.*', '')")} ELSE a END) AS answer, CASE WHEN has THEN md5({strip_sql("regexp_extract(a, '(?ims)^Citation:[[:space:]]*(.*)', 1)")}) END AS citation
FROM (SELECT doc_id, a, regexp_matches(a, '(?im)^Citation:') AS has FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'citation:  ' || source || chr(10) || 'more' ELSE '' END AS a FROM documents))""")
def _(x):
    a = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\ncitation:  "), "source", F.lit("\nmore"))).otherwise(""))
    return _d(x, t.split_citation(a).alias("s")).select("doc_id", fingerprint(F.col("s.answer")).alias("answer"), fingerprint(F.col("s.citation")).alias("citation"))


@query("txt18_strip_fences", rf"""
SELECT doc_id, md5(CASE WHEN starts_with(f, '```') THEN regexp_replace(regexp_replace(f, '(?i)^```(?:json)?\s*', ''), '\s*```$', '') ELSE f END) AS h
FROM (SELECT doc_id, {strip_sql("CASE WHEN doc_id % 2 = 0 THEN ' ```JSON' || chr(10) || text || chr(10) || '```  ' ELSE text END")} AS f FROM documents)""")
def _(x):
    f = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" ```JSON\n"), "text", F.lit("\n```  "))).otherwise(F.col("text"))
    return _d(x, fingerprint(t.strip_fences(f)).alias("h"))


@query("txt19_strip_thinking", rf"""
SELECT doc_id, md5({strip_sql("regexp_replace('<think>' || text || '</think> ' || source || '<think>x</think>', '(?s)<think>.*?</think>', '', 'g')")}) AS h FROM documents""")
def _(x):
    return _d(x, fingerprint(t.strip_thinking(F.concat(F.lit("<think>"), "text", F.lit("</think> "), "source", F.lit("<think>x</think>")))).alias("h"))


@query("txt20_html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace('<a href=\"x\">' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM documents")
def _(x):
    return _d(x, fingerprint(t.html_escape(F.concat(F.lit('<a href="x">'), "text"))).alias("h"))


@query("txt21_wrap_label", r"""
SELECT doc_id, CASE WHEN len(w) <= 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:4], ' ') || chr(10) || array_to_string(w[5:8], ' ') || CASE WHEN len(w) > 8 THEN '...' ELSE '' END END AS label
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def _(x):
    return _d(x, t.wrap_label("text").alias("label"))


_DEPTH_SQL = "['Bloom Level 1', 'understanding', 'apply it', 'Bloom level 4', 'Evaluate', 'create', 'other'][doc_id % 7 + 1]"


def _depth():
    return F.get(F.array(*map(F.lit, ["Bloom Level 1", "understanding", "apply it", "Bloom level 4", "Evaluate", "create", "other"])), (F.col("doc_id") % 7).cast("int"))


@query("txt22_bloom_level", "SELECT doc_id, [1, 2, 3, 4, 5, 6, NULL][doc_id % 7 + 1]::INTEGER AS level, doc_id % 7 = 1 AS understanding FROM documents")
def _(x):
    return _d(x, t.bloom_level(_depth()).alias("level"), t.is_understanding(_depth()).alias("understanding"))


@query("txt24_answer_tier", "SELECT doc_id, CASE WHEN doc_id % 21 > 15 THEN 'essay' WHEN doc_id % 21 > 5 THEN 'paragraphs' ELSE 'short' END AS tier FROM documents")
def _(x):
    return _d(x, t.answer_tier(F.col("doc_id") % 21).alias("tier"))


@query("prj22_prompt_stats", f"""
SELECT doc_id, length(text)::INTEGER AS chars, {words('text')} AS words, greatest(1, length(text) // 4)::INTEGER AS est_tokens, len(regexp_extract_all(text, 'the '))::INTEGER AS n_0 FROM documents""")
def _(x):
    from marginalia.operators.requests import prompt_stats

    return prompt_stats(x.documents.select("doc_id", "text"), "text", ("the ",)).drop("text")


@query("txt5_infer_level", r"""
SELECT doc_id, CASE WHEN regexp_matches(m, '^(chapter|unit|part|module|section)') THEN 1 WHEN contains(m, '.') AND n >= 2 THEN least(n, 5) WHEN regexp_matches(m, '^(example|figure|table)') THEN 3 ELSE 2 END::INTEGER AS level
FROM (SELECT doc_id, m, len(regexp_extract_all(m, '\d+')) AS n FROM (SELECT doc_id, lower(['Unit 3', '1.2', '1.2.3', '1.2.3.4.5.6', 'Figure 3', 'figure 3.1', 'Section 2', 'subsection 4'][doc_id % 8 + 1]) AS m FROM documents))""")
def _(x):
    marks = F.array(*map(F.lit, ["Unit 3", "1.2", "1.2.3", "1.2.3.4.5.6", "Figure 3", "figure 3.1", "Section 2", "subsection 4"]))
    return _d(x, chunking.infer_level(F.get(marks, (F.col("doc_id") % 8).cast("int"))).alias("level"))


# Parsing ---------------------------------------------------------------------------------------


@query("jsn2_json_questions", """
SELECT doc_id, (j - 1)::INTEGER AS idx, CASE WHEN doc_id % 4 = 3 THEN 'plain ' || source WHEN doc_id % 4 = 2 THEN 'q0 ' || source ELSE 'q' || (j - 1) || ' ' || source END AS question,
       CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'a' END AS answer, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN j = 1 THEN 'c' ELSE lang END AS citation
FROM (SELECT *, unnest(CASE WHEN doc_id % 4 < 2 THEN [1, 2] ELSE [1] END) AS j FROM documents)""")
def _(x):
    n, s = F.col("doc_id") % 4, F.col("source")
    one = F.concat(F.lit('{"question": " q0 '), s, F.lit('", "answer": "a", "citation": "c"}'))
    two = F.concat(one, F.lit(', {"question": "q1 '), s, F.lit(' ", "answer": "a\\nCitation: '), F.col("lang"), F.lit('"}'))
    out = F.when(n == 0, F.concat(F.lit("```json\n["), two, F.lit("]\n```"))).when(n == 1, F.concat(F.lit('Sure: {"questions": ['), two, F.lit("]}"))).when(n == 2, one).otherwise(F.concat(F.lit("plain "), s))
    return parsing.explode_questions(x.documents.select("doc_id", out.alias("output"))).drop("output", "rubric")


@query("jsn3_tag_questions", """
SELECT doc_id, (j - 1)::INTEGER AS idx, 'q' || j || ' ' || source AS question, CASE WHEN j = 2 AND doc_id % 2 = 1 THEN '' ELSE 'a' || j END AS answer FROM (SELECT *, unnest([1, 2]) AS j FROM documents)""")
def _(x):
    s = F.col("source")
    q = lambda k: F.concat(F.lit(f"<Question>q{k} "), s)
    out = F.concat(q(1), F.lit("</Question><Answer>a1</Answer>"), q(2), F.when(F.col("doc_id") % 2 == 0, "<answer>a2").otherwise("</Question>"))
    return parsing.explode_questions(x.documents.select("doc_id", out.alias("output"))).select("doc_id", "idx", "question", "answer")


@query("jsn5_review", """
SELECT doc_id, [7, 8, NULL, NULL][doc_id % 4 + 1]::INTEGER AS rating, CASE WHEN doc_id % 2 = 0 THEN source ELSE r END AS feedback, CASE WHEN doc_id % 3 = 0 THEN 'try ' || lang ELSE 'None' END AS alternative
FROM (SELECT *, ['<Rating>7</Rating>', '<Rating> 8/10 </Rating>', '<Rating>good</Rating>', ''][doc_id % 4 + 1] || CASE WHEN doc_id % 2 = 0 THEN '<Feedback> ' || source || ' </Feedback>' ELSE 'free' END || CASE WHEN doc_id % 3 = 0 THEN '<Alternative>try ' || lang || '</Alternative>' ELSE '' END AS r FROM documents)""")
def _(x):
    n = F.col("doc_id")
    rating = F.get(F.array(*map(F.lit, ["<Rating>7</Rating>", "<Rating> 8/10 </Rating>", "<Rating>good</Rating>", ""])), (n % 4).cast("int"))
    out = F.concat(rating, F.when(n % 2 == 0, F.concat(F.lit("<Feedback> "), "source", F.lit(" </Feedback>"))).otherwise("free"), F.when(n % 3 == 0, F.concat(F.lit("<Alternative>try "), "lang", F.lit("</Alternative>"))).otherwise(""))
    return _d(x, parsing.review(out).alias("r")).select("doc_id", "r.*")


@query("jsn4_old_questions", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'q ' || source WHEN 1 THEN 'Why ' || source || '?' ELSE 'lead' END AS question, CASE doc_id % 4 WHEN 0 THEN 'No answer provided.' WHEN 1 THEN 'because' ELSE 'so it is' END AS answer FROM documents WHERE doc_id % 4 < 3""")
def _(x):
    n, s = F.col("doc_id") % 4, F.col("source")
    out = F.when(n == 0, F.concat(F.lit("<Question>**Question 3** q "), s, F.lit("</Question>"))).when(n == 1, F.concat(F.lit("### QUESTION\nQuestion 1: Why "), s, F.lit("?\n### ANSWER\nAnswer: because Note: x"))).when(n == 2, "lead\nAnswer\n so it is").otherwise("nothing")
    return x.documents.select("doc_id", F.explode(parsing.old_questions(out)).alias("q")).select("doc_id", "q.*")
