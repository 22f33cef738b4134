"""The queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, codes, html_text, line_dedup, mixing, near_dup, packed, periodic, quality, secrets, sharding, topk
from marginalia.llm.base import WORD, checkpointed, let, modest_batches, n_words, scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpointed(_read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    x = mixing.mix_sources(counted, size_col="size")
    return x.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations")).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = checkpointed(quality.measured(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    return quality.verdicts(measures).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    modest_batches(spark)
    x = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, bytes_col="decoded")
    return x.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_packed_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("word_bpe_49k.json")
    bits = packed.bits_for(packed.word_encoder(path).tokenizer.get_vocab_size(True))
    out = scratch(spark, "tokens")
    manifest = packed.write_tokens(_read(spark, sf_dir, "documents"), out, lambda: packed.word_encoder(path, special=True), bits, end_id=1)
    return packed.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), copied_by=5, by_text=True)
    count = lambda *is_: F.size(F.filter("found", lambda s: s["kind"].isin(*is_))).cast("long")
    return x.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(secrets.told(F.col("found"), lambda s: s["base"]), 256).alias("base_sha256"),
        secrets.told(F.col("found")).alias("spans"), secrets.told(F.col("found"), lambda s: s["verdict"] == "live").alias("live_spans"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.train(vectors, parts=16, entries=64, rounds=2, scale=256)
    x = codes.with_group_error(codes.encode(vectors, books), "label")
    return x.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("group_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.sharded(_read(spark, sf_dir, "documents"), shards=24)
    return x.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _periodic(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth id or so with its words from some place on replaced by repetitions of the first of them."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        place = F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))
        word = lambda i, x: F.get(w, F.when(i < x["a"], i.cast("long")).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))
        return F.when(n == 0, F.lit("")).otherwise(let(place, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(i, x)), " ")))

    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, let(words, again)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", _periodic(F.col("doc_id"), F.col("text")).alias("text"))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))  # the first of equals
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return periodic.find_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_mixing, op3_line_dedup, op4_chat_format, op5_quality_rules, op6_byte_bpe, op7_exact_top_k, op8_packed_tokens, op9_html_text, op10_secret_scan, op11_vector_codes, op12_sharding, op13_periodic_runs)}
