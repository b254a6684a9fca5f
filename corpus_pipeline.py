"""The corpus pipeline: quality rules, language ID, near-duplicate and substring dedup, packing.

Each stage works on all documents that its predecessor kept; what it decides is in what it returns.
SQL cannot express a learned classifier or a tokenizer, so the result is tested against brute force.

Null and empty texts and those without letters are refused by the first two stages, whatever else they carry.
Rows with a null doc_id are judged by their text alone and have no duplicates. Of repeated rows of one doc_id one
stays. Of documents that are alike the smallest doc_id stays. Very long texts pass whole, as any other. Empty
tables give empty ones. Further columns of documents are handed on, whatever their names, until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import langid, neardup, packing, quality, substrings
from kgspark.checkpoints import saved, scratch
from kgspark.llm.common import documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the threshold table keeps."""
    return quality.filtered(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are near enough to a language learned from those not held out."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 0.8 of their five-word shingles."""
    return neardup.deduplicated(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of windows of 13 that start in a smaller document; emptied ones go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substrings.substring_dedup(docs, keep=others, output="text").where("n_removed = 0 or n_removed < n_words")
    out = found.withColumnRenamed("kept", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables between the stages go when they are written."""
    docs = documents(spark, sf_dir)
    with scratch(spark):
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
    return docs
