"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import byte_pairs, decontamination, near_duplicates, passages, toxicity
from boxloom.llm.common import fresh_folder, held_out, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    verdict = toxicity.train(docs, known)
    return toxicity.keep_clean(docs, verdict).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component; rows without id stay."""
    out = near_duplicates.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(out, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier document holds; ``n_chars`` follows the text."""
    left = passages.remove_repeats(docs)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col("leak"), "left_anti").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (32-bit little-endian), their number, and the text they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_pairs.round_trip(docs, path, pattern)
    return coded.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats), ("decontamination", drop_leaks), ("byte_pairs", to_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
