"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, filteraudit, graphann, langid, media, neardup, packing, pii, runs, secrets, tokenfiles, urlfilter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs.filter(~langid.held_out()))
    return langid.predict_language(docs, profiles).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op3_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphann.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op5_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digest_formatted(chat.format_conversations(turns.unionByName(added)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_file_round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_runs(runs.find_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    ops = (op1_harmonic_packing, op2_language_id, op3_media_archive, op4_nn_descent, op5_chat_masks, op6_secret_scan, op7_order_minhash, op8_bpe_queue, op9_bit_planes, op10_pii_anchors, op11_periodic_runs, op12_filter_audit, op13_url_filter)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """The first eleven can't be expressed in SQL; tests/llm holds them against brute force."""
    return {"op12_filter_audit": filteraudit.AUDIT_SQL, "op13_url_filter": urlfilter.judge_sql()}
