"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next one's docs.  All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from loomhouse.llm import bpe, decontaminate, langid, line_dedup, simhash
from loomhouse.llm.common import made, release, remove, table, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of all documents; documents that the model rejects go."""
    return langid.accepted(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines stay in one place only; n_chars is that of the text that is left."""
    return line_dedup.clean(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: fingerprints within 3 bits, or five-word shingles 0.8 alike."""
    return simhash.distinct(docs, alike=True, null_ids=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives its bytes again."""
    out = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("bpe.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", F.size("bpe.ids").cast("bigint").alias("n_tokens"), F.col("bpe.ids").alias("ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encode_bpe),
]

#: SQL has neither the language models nor XXH64; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables go when its result is written, its input when it is read."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, last = len(made), path
        docs, path = written(stage(spark, docs, sf_dir), name)
        for gone in [p for p in made[before:] if p != path] + ([last] if last else []):
            remove(spark, gone)
        release(spark)
    return docs
