"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fm_dedup, lm_score, ngram_join, quality, sentencepiece_codec, sql, suffix_dedup, toxicity, warc
from ._shared import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    return views.withColumn("spans", F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_substrings(_table(spark, sf_dir, "documents")).drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


QUERIES = {f.__name__: f for f in (op1_chat_rotation, op2_suffix_dedup, op3_toxicity, op4_lm_score, op5_fm_dedup, op6_decontamination, op7_ngram_join, op8_sentencepiece, op9_quality, op10_warc)}
#: Toxicity, LM scores and token ids are beyond SQL; tests hold them against held-out labels, brute force and the library.
SQL: dict[str, str] = {
    "op1_chat_rotation": sql.OP1,
    "op2_suffix_dedup": sql.OP2,
    "op5_fm_dedup": sql.OP5,
    "op6_decontamination": sql.OP6,
    "op7_ngram_join": sql.OP7,
    "op9_quality": sql.OP9,
    "op10_warc": sql.OP10,
}
