"""Documents to training tokens: language, near copies, repeated passages, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.langid import known_rows
from basketry.llm.minhash import keep_one
from basketry.llm.mixing import take_mix
from basketry.llm.pieces import encode_texts
from basketry.llm.queries import PIECE_MODEL
from basketry.llm.suffixes import remove_repeats
from basketry.plans.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go."""
    return known_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that also start earlier; ``n_chars`` is that of the shorter text."""
    cut = remove_repeats(docs, keep=tuple(c for c in docs.columns if c != "text"))
    text = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return cut.select(*[text[c].alias(c) if c in text else F.col(f"row.{c}").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return take_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids with merge dropout, and whether they decode to its text."""
    return encode_texts(docs, PIECE_MODEL)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix", mix),
    ("pieces", pieces),
]

#: SQL cannot express the trained language model nor the merges; a test holds all stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
