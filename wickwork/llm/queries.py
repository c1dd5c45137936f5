"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.llm import langid, licenses, media, mixing, near_dedup, packing, phrases, quality, sharding, token_counts, topk, warc, whitening

TOKENIZER, TOKEN_LIMIT, SHARDS = "byte_bpe_50k.json", 1024, 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.prefix_tokens(docs, public_tokenizers.path(TOKENIZER), TOKEN_LIMIT, keep_table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("cut").cast("long").alias("cut_chars"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_uniform(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_dedup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "class_id", "class_size", "n_links")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return media.text_images(docs, keep_media=False).drop("text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.fair_queue(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents").select("text", "lang"), top=2000, least=30)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_token_counts, op2_sharding, op3_near_dedup, op4_warc, op5_webp, op6_licenses, op7_mixing, op8_quality, op9_packing, op10_language, op11_phrases, op12_whitening, op13_topk)
    return {f.__name__: f for f in made}
