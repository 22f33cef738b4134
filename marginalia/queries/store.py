"""Queries of the store, requests, views and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.scoring import score_percent
from marginalia.functions.text import QUESTION_TYPES
from marginalia.operators import catalog, counters, export, ranks, requests, store
from marginalia.plans import api
from marginalia.queries.registry import fingerprint, query, strip_sql
from marginalia.sources.shared import scratch
from marginalia.streaming import machine


def _questions(x):
    """Documents as questions: the order is doc_id, sessions are of seven."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    y = x.documents.select(
        n.alias("row_index"), F.concat(F.lit("q"), s(n)).alias("id"), F.concat(F.lit("s"), s(F.floor(n / 7))).alias("session_id"), F.col("text").alias("question"), F.col("source").alias("answer"),
        F.when(n % 5 > 0, (n % 11) / 2).alias("alignment_score"), F.col("lang").alias("subject"), F.concat(F.lit("Block "), s(n % 13)).alias("chapter"), F.when(n % 3 == 0, "Bloom level 2").alias("depth"),
        F.when(n % 2 == 0, F.concat(F.lit('{"marks": [{"criterion": "c", "marks": "2"}, {"label": "l", "score": "'), s(n % 4), F.lit('"}, {"name": "x", "value": "?"}], "key_points": ["k1", "k2"]}'))).when(n % 7 == 0, F.lit('{"total": "20"}')).alias("rubric"),
        F.when(n % 4 == 0, F.lit('{"chairman": "m"}')).alias("board_metadata"), F.when(n % 3 > 0, n % 3 == 1).alias("is_rag"), F.lit(None).cast("boolean").alias("use_citation"),
        F.when(n % 6 > 0, F.concat(F.lit('{"ncert": '), s(n % 5), F.lit("}"))).alias("scores"),
        F.when(n % 8 > 0, F.concat(F.lit('{"subject": "'), F.col("lang"), F.lit('", "num_questions": '), s(n % 4), F.when(n % 2 == 0, F.lit(', "use_rag": false')).otherwise(""), F.lit("}"))).otherwise("broken {").alias("request"))
    return y


_SESSIONS_SQL = "sessions AS (SELECT user_id, 's' || user_id AS id, min(ts) AS created_at, (3 + user_id % 200)::INTEGER AS total_requested FROM events GROUP BY user_id)"


def _sessions(x):
    y = x.events.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("created_at"))
    return y.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id"), "created_at", F.lit("pending").alias("status"), (3 + F.col("user_id") % 200).cast("int").alias("total_requested"), F.lit(0).alias("total_generated"))


def _events(x):
    status = F.when(F.col("event_type") == "purchase", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "completed")
    return x.events.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("n"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))


@query("top4_recent_sessions", f"WITH {_SESSIONS_SQL} SELECT id, total_requested FROM sessions ORDER BY created_at DESC, id LIMIT 50")
def _(x):
    return api.recent_sessions(_sessions(x)).select("id", "total_requested")


_PROGRESS = """
SELECT s.id, e.n::INTEGER AS total_generated, CASE WHEN e.n >= s.total_requested THEN 'completed' ELSE coalesce(e.st, 'pending') END AS status
FROM sessions s JOIN (SELECT 's' || user_id AS id, sum(event_id % 3) AS n, arg_max(CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END, event_id) FILTER (event_type IN ('purchase', 'error', 'signup')) AS st FROM events GROUP BY user_id) e ON e.id = s.id"""


@query("agg10_session_progress", f"WITH {_SESSIONS_SQL} {_PROGRESS}")
def _(x):
    return store.progress(_sessions(x), _events(x)).select("id", "total_generated", "status")


@query("str2_session_status_latest", """
SELECT 's' || user_id AS session_id, arg_max(CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END, event_id) AS status FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id""")
def _(x):
    return store.last_wins(_events(x).filter("status IS NOT NULL"), "session_id", "seq").select("session_id", "status")


@query("snk7_incremental_progress", f"WITH {_SESSIONS_SQL} {_PROGRESS}")
def _(x):
    """The log in three appends, a refresh after each and one for nothing; what was summed up is put together once."""
    path, log = scratch(x.spark, "counters"), _events(x)
    for bound in ("seq % 1000 < 0", "seq < 2000", "seq < 5000", "true", "true"):
        counters.refresh(log.filter(bound), path)
        if bound == "seq < 5000":
            counters.compact(x.spark, path)
    return store.progress(_sessions(x), counters.rows(x.spark, path)).select("id", "total_generated", "status")


@query("top5_deep_page", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET (SELECT count(*) * 3 // 4 FROM events)")
def _(x):
    path, e = scratch(x.spark, "ranks"), x.events.select("event_id", "user_id", "event_type", "ts")
    ranks.write(e, path, ("ts", "event_id"), range_rows=1000)
    return ranks.page(x.spark, path, ("ts", "event_id"), e.count() * 3 // 4).select("event_id", "user_id", "event_type")


@query("str1_session_outcomes", """
WITH e AS (SELECT 's' || user_id || ' ' || strftime(ts, '%Y-%m-%d') AS session_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed' END AS status, event_id % 3 AS n, ts, 1 + user_id % 4 AS asked FROM events),
s AS (SELECT session_id, min(ts) AS started FROM e GROUP BY 1),
g AS (SELECT session_id, started, arg_max(status, seq) FILTER (status IS NOT NULL) AS said, sum(n)::BIGINT AS total_generated, max(asked)::BIGINT AS total_requested, max(seq)::BIGINT AS last_seq
  FROM e JOIN s USING (session_id) WHERE ts <= started + INTERVAL 3 HOUR GROUP BY ALL),
o AS (SELECT *, total_generated >= total_requested AS enough, coalesce(said, '') NOT IN ('completed', 'failed') AND (SELECT max(ts) FROM events) >= started + INTERVAL 3 HOUR AS late FROM g)
SELECT session_id, CASE WHEN enough THEN 'completed' WHEN late THEN 'failed' ELSE coalesce(said, 'pending') END AS status, CASE WHEN NOT enough AND late THEN 'time limit' END AS reason, total_generated, total_requested, last_seq, started FROM o""")
def _(x):
    e = x.events.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "total_requested": 1 + F.col("user_id") % 4}).select("event_id", "day", "total_requested")
    e = _events(x).join(e.withColumnRenamed("event_id", "seq"), "seq").withColumn("session_id", F.concat_ws(" ", "session_id", "day"))
    return machine.outcomes(e).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("prj20_session_cards", f"WITH {_SESSIONS_SQL}, p AS ({_PROGRESS}) SELECT p.id, round(100.0 * p.total_generated / s.total_requested)::INTEGER AS percent, strftime(s.created_at, '%Y-%m-%d') AS day FROM p JOIN sessions s ON s.id = p.id")
def _(x):
    return export.session_cards(store.progress(_sessions(x), _events(x))).select("id", "percent", "day")


@query("snk6_new_sessions", f"WITH {_SESSIONS_SQL} SELECT id, 'pending' AS status, total_requested, 0::INTEGER AS total_generated, '{{\"n\":' || total_requested || '}}' AS parameters FROM sessions")
def _(x):
    return store.new_session(_sessions(x).withColumn("parameters", F.struct(F.col("total_requested").alias("n")))).drop("created_at")


@query("snk5_new_questions", rf"""
SELECT md5('s' || (doc_id // 7) || '|' || (doc_id % 7)) AS id, (row_number() OVER (ORDER BY 's' || (doc_id // 7), doc_id % 7) - 1 + 1000)::BIGINT AS row_index, md5({strip_sql('text')}) AS question, source AS answer,
  coalesce(CASE WHEN doc_id % 2 = 0 THEN 'm' || (doc_id % 3) END, 'groq-llama-70b') AS model_id, NULL::VARCHAR AS citation FROM documents""")
def _(x):
    n = F.col("doc_id")
    parsed = x.documents.select(F.concat(F.lit("s"), F.floor(n / 7).cast("string")).alias("session_id"), (n % 7).alias("idx"), F.col("text").alias("question"), F.concat(F.lit(" "), "source", F.lit("\n")).alias("answer"), F.when(n % 2 == 0, F.concat(F.lit("m"), (n % 3).cast("string"))).otherwise("").alias("model_id"))
    y = store.new_questions(parsed, first_index=1000)
    return y.select("id", "row_index", fingerprint(F.col("question")).alias("question"), "answer", "model_id", "citation")


@query("snk9_schema_evolution", "SELECT doc_id AS row_index, lang AS subject, NULL::VARCHAR AS citation, NULL::DOUBLE AS generation_time_ms FROM documents")
def _(x):
    return store.evolve(x.documents.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("subject")), store.QUESTION).select("row_index", "subject", "citation", "generation_time_ms")


@query("agg14_last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(x):
    return store.last_wins(x.events, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("top5_question_page", "SELECT doc_id AS row_index, source AS answer FROM documents ORDER BY doc_id DESC LIMIT 25 OFFSET 50")
def _(x):
    return store.page(_questions(x), 50, 25).select("row_index", "answer")


@query("top6_session_questions", "SELECT doc_id AS row_index, 'q' || doc_id AS id FROM documents WHERE doc_id // 7 = 3")
def _(x):
    return store.of_session(_questions(x), "s3").select("row_index", "id")


@query("jn9_sessions_with_questions", f"WITH {_SESSIONS_SQL} SELECT s.id, d.doc_id AS row_index FROM sessions s LEFT JOIN documents d ON s.id = 's' || (d.doc_id // 7)")
def _(x):
    return store.with_questions(_sessions(x), _questions(x)).select("id", "row_index")


@query("agg4_question_bounds", "SELECT 'q' || min(doc_id) AS earliest_id, 'q' || max(doc_id) AS latest_id FROM documents")
def _(x):
    return store.bounds(_questions(x))


@query("win1_navigation", "SELECT 'q' || doc_id AS id, 'q' || lag(doc_id) OVER (ORDER BY doc_id) AS prev_id, 'q' || lead(doc_id) OVER (ORDER BY doc_id) AS next_id, lag(doc_id) OVER (ORDER BY doc_id) IS NOT NULL AS has_prev, lead(doc_id) OVER (ORDER BY doc_id) IS NOT NULL AS has_next FROM documents")
def _(x):
    return store.navigation(_questions(x)).select("id", "prev_id", "next_id", "has_prev", "has_next")


@query("jn8_next_question", "SELECT 'q' || min(doc_id) AS id, true AS has_prev, min(doc_id) < (SELECT max(doc_id) FROM documents) AS has_next FROM documents WHERE doc_id > 17")
def _(x):
    return store.question_view(_questions(x), "next", "q17").select("id", "has_prev", "has_next")


@query("prj11_normalized_questions", """
SELECT doc_id AS row_index, CASE WHEN doc_id % 3 = 0 THEN 'Bloom level 2' END AS category, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 5)::DOUBLE END AS ncert, (doc_id % 3 = 1) AS is_rag, false AS use_citation FROM documents""")
def _(x):
    y = store.normalized(_questions(x))
    return y.select("row_index", "category", F.try_element_at("scores", F.lit("ncert")).alias("ncert"), "is_rag", "use_citation")


@query("prj12_request_summary", """
SELECT doc_id AS row_index, CASE WHEN doc_id % 8 > 0 THEN lang END AS subject, CASE WHEN doc_id % 8 > 0 THEN doc_id % 4 END::INTEGER AS num_questions, NOT (doc_id % 8 > 0 AND doc_id % 2 = 0) AS use_rag, true AS enable_alignment FROM documents""")
def _(x):
    return _questions(x).withColumn("r", store.request_summary("request")).select("row_index", "r.subject", "r.num_questions", "r.use_rag", "r.enable_alignment")


@query("jsn8_json_or_text", "SELECT doc_id AS row_index, CASE WHEN doc_id % 8 > 0 THEN lang END AS subject, CASE WHEN doc_id % 8 = 0 THEN 'broken {' END AS raw FROM documents")
def _(x):
    return _questions(x).withColumn("j", store.json_or_text("request", "subject string")).select("row_index", "j.value.subject", "j.raw")


@query("prj13_enriched_questions", "SELECT doc_id AS row_index, 5::INTEGER AS requested_count, count(*) OVER (PARTITION BY doc_id // 7)::INTEGER AS generated_count, count(*) OVER (PARTITION BY doc_id // 7) < 5 AS count_warning FROM documents")
def _(x):
    return store.enrich(_questions(x), "session_id", F.lit(5)).select("row_index", "requested_count", "generated_count", "count_warning")


# Views and export ------------------------------------------------------------------------------

_RUBRIC_SQL = "CASE WHEN doc_id % 2 = 0 THEN '[Marks]' || chr(10) || 'c - 2 marks' || chr(10) || 'l - ' || (doc_id % 4) || ' marks' || chr(10) || 'x - ? marks' || chr(10) || chr(10) || '[Key Points]' || chr(10) || '1. k1' || chr(10) || '2. k2' ELSE '' END"


@query("prj15_rubric_text", f"SELECT doc_id AS row_index, {_RUBRIC_SQL} AS rubric_text FROM documents")
def _(x):
    return _questions(x).select("row_index", F.coalesce(export.rubric_text(export.rubric("rubric")), F.lit("")).alias("rubric_text"))


@query("agg9_rubric_totals", "SELECT doc_id AS row_index, CASE WHEN doc_id % 2 = 0 THEN 2 + doc_id % 4 WHEN doc_id % 7 = 0 THEN 20 ELSE 10 END::DOUBLE AS total FROM documents")
def _(x):
    return _questions(x).select("row_index", export.rubric_total(export.rubric("rubric")).alias("total"))


@query("snk11_export_sheet", f"""
SELECT lang AS course, 'Block ' || (doc_id % 13) AS block, CASE WHEN doc_id % 3 = 0 THEN 'Bloom level 2' ELSE '' END AS bloom_level, md5(text) AS question, source AS answer, {_RUBRIC_SQL} AS rubric, '' AS valid_qa, '' AS comments FROM documents""")
def _(x):
    return export.sheet(_questions(x)).withColumn("question", F.md5("question"))


@query("snk12_print_pages", "SELECT doc_id AS row_index, row_number() OVER (ORDER BY doc_id)::INTEGER AS row_no, ((row_number() OVER (ORDER BY doc_id) - 1) // 5 + 1)::INTEGER AS page_no FROM documents")
def _(x):
    return export.print_pages(_questions(x)).select("row_index", "row_no", "page_no")


@query("prj17_list_view", rf"""
SELECT doc_id AS row_index, CASE WHEN doc_id % 4 = 0 THEN 'Council' ELSE 'Single' END AS mode, CASE WHEN doc_id % 3 = 1 THEN 'RAG' ELSE 'Direct' END AS rag,
  md5(replace(replace(replace(replace(replace(CASE WHEN length(l) > 120 THEN left(l, 120) || '...' ELSE l END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS preview
FROM (SELECT doc_id, {strip_sql(r"regexp_replace(text, '\s+', ' ', 'g')")} AS l FROM documents)""")
def _(x):
    return export.list_view(_questions(x)).select("row_index", "mode", "rag", fingerprint(F.col("preview")).alias("preview"))


@query("api2_question_list", "SELECT doc_id AS row_index, CASE WHEN doc_id % 4 = 0 THEN 'Council' ELSE 'Single' END AS mode FROM documents ORDER BY doc_id DESC LIMIT 25")
def _(x):
    return api.question_list(_questions(x)).select("row_index", "mode")


@query("api2_question_stack", "SELECT 'q' || max(doc_id) AS id, count(*) > 1 AS has_prev, false AS has_next FROM documents")
def _(x):
    return api.question_stack(_questions(x)).select("id", "has_prev", "has_next")


@query("api1_health", "SELECT (SELECT count(*) FROM documents)::BIGINT AS n_documents, (SELECT count(*) FROM pages)::BIGINT AS n_questions, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS n_sessions, 'ok' AS status")
def _(x):
    return api.health(x.documents, x.pages, _sessions(x))


@query("flt14_session_lookup", f"WITH {_SESSIONS_SQL}, p AS ({_PROGRESS}) SELECT id, total_generated, status FROM p WHERE id = 's7'")
def _(x):
    return api.session(_sessions(x), _events(x), "s7").select("id", "total_generated", "status")


@query("flt17_filled_entries", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a,c' WHEN doc_id % 3 = 1 THEN 'c' ELSE 'b,c' END AS keys FROM documents")
def _(x):
    n = F.col("doc_id") % 3
    m = F.create_map(F.lit("a"), F.when(n == 0, "x").otherwise(""), F.lit("b"), F.when(n == 2, "y"), F.lit("c"), F.col("source"))
    return x.documents.select("doc_id", F.array_join(F.array_sort(F.map_keys(export.filled(m))), ",").alias("keys"))


# Requests --------------------------------------------------------------------------------------


@query("flt13_request_problems", """
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 4 THEN 'question type' END, CASE WHEN doc_id % 4 = 0 THEN 'number of questions' END, CASE WHEN doc_id % 3 = 2 THEN 'temperature' END, CASE WHEN doc_id % 21 > 20 OR doc_id % 22 = 21 THEN 'rubric marks' END,
  CASE WHEN doc_id % 2 = 0 THEN 'model' END, CASE WHEN doc_id % 7 = 0 THEN 'chairman among members' END, CASE WHEN doc_id % 11 = 0 AND doc_id % 7 > 0 THEN 'unknown member' END) AS problems FROM documents""")
def _(x):
    n = F.col("doc_id")
    kinds = F.array(*map(F.lit, [*QUESTION_TYPES, "Essay"]))
    allowed = F.array(*map(F.lit, ["m1", "m2", "m3"]))
    members = F.when(n % 7 == 0, F.array(F.lit("m1"), F.lit("m2"))).when(n % 11 == 0, F.array(F.lit("m2"), F.lit("zz"))).otherwise(F.array(F.lit("m2"), F.lit("m3")))
    p = requests.problems(F.get(kinds, (n % 5).cast("int")), n % 4, (n % 3) / 1.9, F.when(n % 22 == 21, 21.0).otherwise(5.0), F.when(n % 2 == 0, "bad").otherwise("m1"), F.lit("m1"), members, allowed)
    return x.documents.select("doc_id", F.array_join(p, ",").alias("problems"))


@query("prj14_search_query", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'ch' ELSE 'ch ' || lang END AS q FROM documents")
def _(x):
    n = F.col("doc_id") % 3
    return x.documents.select("doc_id", requests.search_query("source", F.when(n > 0, "ch").otherwise(""), F.when(n == 2, F.col("lang"))).alias("q"))


@query("prj23_model_id", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'groq-x' WHEN 1 THEN 'groq-llama-70b' WHEN 2 THEN 'ollama-y' ELSE 'fallback' END AS model FROM documents")
def _(x):
    n = F.col("doc_id") % 4
    return x.documents.select("doc_id", requests.model_id(F.when(n == 0, " groq-x ").when(n == 1, "rag-piped-groq-70b").when(n == 2, "ollama-y").otherwise("zz"), "fallback").alias("model"))


@query("prj26_chat_subject", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Maths' WHEN 8 + doc_id % 5 = 10 THEN 'Science' ELSE source END AS subject FROM documents")
def _(x):
    n = F.col("doc_id")
    return x.documents.select("doc_id", requests.chat_subject(F.when(n % 3 == 0, "Mathematics").otherwise(F.col("source")), 8 + n % 5).alias("subject"))


@query("top10_fan_out", "SELECT doc_id, (j - 1)::INTEGER AS task_idx, least(2, doc_id % 8 - 2 * (j - 1))::INTEGER AS task_size FROM (SELECT doc_id, unnest(range(1, 1 + (doc_id % 8 + 1) // 2)) AS j FROM documents)")
def _(x):
    return requests.fan_out(x.documents.select("doc_id", (F.col("doc_id") % 8).cast("int").alias("num_questions"))).drop("num_questions")


@query("top8_first_rows", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def _(x):
    return requests.first_rows(x.documents.select("lang", "doc_id"), "lang", "doc_id", F.lit(3))


@query("win5_row_numbers", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS row_no FROM documents")
def _(x):
    return requests.numbered(x.documents.select("lang", "doc_id"), ("lang",), "doc_id")


@query("txt23_prompt", """
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 THEN '# Source' || chr(10) || source END,
  CASE WHEN doc_id % 3 = 0 THEN '# Citation' || chr(10) || 'Quote one passage of the source word for word in `citation`, without page marks.' ELSE '# No citation' || chr(10) || 'Do not mention the source.' END,
  '# Task' || chr(10) || 'Write ' || greatest(1, doc_id % 4) || ' question(s) of type Short Answer on ch (' || lang || ').', '# Depth' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Bloom level 3' ELSE 'As fits the level asked for' END,
  '# Answer' || chr(10) || 'Give ' || CASE WHEN doc_id % 20 > 15 THEN 'an essay with introduction, body and conclusion' WHEN doc_id % 20 > 5 THEN 'two or three paragraphs' ELSE 'four or five sentences' END || '.',
  '# Verbs' || chr(10) || 'Use verbs such as discuss, differentiate, examine, explain.', '# Language' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN 'Hindi, in Devanagari.' ELSE 'English.' END)) AS h FROM documents""")
def _(x):
    n = F.col("doc_id")
    p = requests.prompt(F.when(n % 2 == 0, F.col("source")), "lang", F.lit("ch"), F.lit("Short Answer"), n % 4, F.when(n % 5 == 0, "apply"), F.when(n % 7 == 0, "HI").otherwise("en"), n % 20, n % 3 == 0)
    return x.documents.select("doc_id", fingerprint(p).alias("h"))


@query("txt23_transcripts", "SELECT conv_id, md5(string_agg(upper(left(role, 1)) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _(x):
    return requests.whole_transcripts(x.conversations, "conv_id", "turn").select("conv_id", fingerprint(F.col("transcript")).alias("h"))


@query("str3_joined_deltas", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _(x):
    return requests.joined_deltas(x.conversations, "conv_id", "turn", "text").select("conv_id", fingerprint(F.col("text")).alias("h"))


@query("set1_union_catalog", "SELECT 'en' AS store, source AS course, doc_id AS pos FROM documents WHERE lang = 'en' UNION ALL SELECT 'hi', source, NULL FROM documents WHERE lang <> 'en'")
def _(x):
    d = x.documents.select(F.col("source").alias("course"), F.col("doc_id").alias("pos"), "lang")
    return catalog.union(en=d.filter("lang = 'en'").drop("lang"), hi=d.filter("lang <> 'en'").select("course"))


@query("set2_distinct_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def _(x):
    return catalog.distinct_values(x.documents, "source")


@query("str4_activity_sessions", """
SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*)::BIGINT AS n_events, sum(n)::BIGINT AS total FROM (
  SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT 's' || user_id AS session_id, ts, event_id % 3 AS n, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INTEGER, 1) AS new FROM events)) GROUP BY session_id, grp""")
def _(x):
    from marginalia.streaming.sessions import activity

    return activity(_events(x)).select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n_events", "total")


@query("str4_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed' END AS status, count(*)::BIGINT AS n_events, sum(event_id % 3)::BIGINT AS total FROM events GROUP BY 1, 2")
def _(x):
    from marginalia.streaming.sessions import tumbling

    return tumbling(_events(x)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str2_running_progress", "SELECT 's' || user_id AS session_id, sum(event_id % 3)::BIGINT AS total, arg_max(CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END, event_id) FILTER (event_type IN ('purchase', 'error', 'signup')) AS last_status FROM events GROUP BY user_id")
def _(x):
    from marginalia.streaming.sessions import running_progress

    return running_progress(_events(x)).drop("seen")


@query("prj21_score_of_five", "SELECT doc_id AS row_index, greatest(0, least(100, round(coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id % 11 / 2 END, 0) / 5 * 100)))::INTEGER AS percent FROM documents")
def _(x):
    return _questions(x).select("row_index", score_percent(F.coalesce("alignment_score", F.lit(0.0))).alias("percent"))


@query("api2_session_questions", """
SELECT 'q' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Bloom level 2' END AS category, md5(text) AS question, doc_id % 3 = 1 AS is_rag, false AS use_citation, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 5)::DOUBLE END AS ncert
FROM documents WHERE doc_id // 7 = 3""")
def _(x):
    y = api.session_questions(_questions(x), "s3")
    return y.select("id", "category", fingerprint(F.col("question_text")).alias("question"), "is_rag", "use_citation", F.try_element_at("scores", F.lit("ncert")).alias("ncert"))


@query("cfg2_chat_form", """
SELECT doc_id, '{"subject":"' || CASE WHEN doc_id % 3 = 0 THEN 'Maths' WHEN 8 + doc_id % 5 = 10 THEN 'Science' ELSE source END || '","language":"' || lang || '","class_level":' || (8 + doc_id % 5) || ',"chapter":"c","chunk_text":"topic' || CASE WHEN doc_id % 2 = 0 THEN '\\n\\ntheme' ELSE '' END || '"}' AS form,
  greatest(1, least(doc_id % 9, 5))::BIGINT AS page FROM documents""")
def _(x):
    n = F.col("doc_id")
    form = requests.chat_form(F.when(n % 3 == 0, "Mathematics").otherwise(F.col("source")), "lang", 8 + n % 5, F.lit("c"), F.lit("topic"), F.when(n % 2 == 0, "theme").otherwise(""))
    return x.documents.select("doc_id", form.alias("form"), requests.page_number(n % 9, F.lit(5)).cast("long").alias("page"))


@query("set6_append_once", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS said FROM documents")
def _(x):
    d = x.documents
    return store.append_once(d.filter("doc_id % 3 = 0").select("doc_id", F.col("source").alias("said")), d.union(d).select("doc_id", F.col("lang").alias("said")), ("doc_id",))


@query("top11_newest_first", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INTEGER AS place FROM events")
def _(x):
    return requests.newest_first(x.events, ("user_id",), "ts", "event_id").select("event_id", "user_id", "place")
