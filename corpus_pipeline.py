"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last
return the columns of documents.  Rows that repeat, null ids and empty tables pass through
every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.llm import decontam, fm_dedup, ngram_join, quality, sentencepiece_codec
from wavelattice.llm._shared import bound_batches, drop, scratch, stored


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), text and key: the id and 128 bits of the text, the same for rows that repeat."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct("doc_id", F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(7), text).alias("r2"))
    return docs.select(F.struct(*docs.columns).alias("row"), "text", key.alias("key"))


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.r1") == F.col(f"{b}.r1")) & (F.col(f"{a}.r2") == F.col(f"{b}.r2")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bound_batches(spark)
    judged = quality.quality_rules(docs.select(F.struct(*docs.columns).alias("row"), "text"), id_col="row")
    return judged.where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words all stay."""
    bound_batches(spark)
    keyed = _keyed(docs)
    found = ngram_join.near_duplicates(keyed, id_col="key")
    stay = found.where(F.col("key") == F.col("component_id")).select(F.col("key").alias("kept_key"), "n_shingles").distinct()
    rows = keyed.join(stay, _same("key", "kept_key"))
    return rows.where("n_shingles > 0").dropDuplicates(["key"]).unionByName(rows.where("n_shingles = 0")).select("row.*")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from the texts; documents of which nothing is left go."""
    bound_batches(spark)
    cut = fm_dedup.remove_repeated_passages(docs, keep_columns=True)
    touched = F.col("n_removed") > 0
    cut = cut.where(~(touched & (F.col("kept") == "")))
    new = {"text": F.when(touched, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bound_batches(spark)
    keyed = _keyed(docs)
    found = decontam.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    leaks = found.where("contaminated").select(F.col("key").alias("leak")).distinct()
    return keyed.join(leaks, _same("key", "leak"), "left_anti").select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the text back."""
    bound_batches(spark)
    coded = sentencepiece_codec.sentencepiece_codec(docs.select(F.struct("doc_id", "text").alias("row"), "text"), id_col="row")
    return coded.select("row.doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("round_trip"), "parity")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Token ids and components of links are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage stores for itself is deleted with it, and its result once the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
