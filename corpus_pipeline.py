"""A training-corpus pipeline over ``documents``, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``, whatever other columns there are.

Each stage's defined cases (nulls, ties, repeated rows, very long texts, empty
tables) are those of its operator: a document whose text is null or has no
letter is rejected by the first stage, so later ones see none; a row with a null
id keeps its lines and has no near copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.llm._common import fresh, table
from knotlog.llm.bpe_codec import recode
from knotlog.llm.language_id import keep_known
from knotlog.llm.line_dedup import line_dedup
from knotlog.llm.near_dedup import keep_first
from knotlog.llm.source_mix import mixed
from knotlog.sources.scratch import remove, scoped, scratch_path

#: The last stage is a learned vocabulary, the first a learned model: SQL has neither.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from these documents' labels."""
    return keep_known(docs, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share.

    A document that loses all its lines goes; ``n_chars`` follows the text.
    """
    prefix = fresh(docs, "line_")
    left, same = F.col(f"{prefix}kept"), F.col(f"{prefix}n_dropped") == 0
    kept = line_dedup(docs, prefix=prefix).where(same | left.rlike(r"[^\x20\x09-\x0D]")).withColumn("text", F.when(same, F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as little-endian unsigned 32-bit integers, and whether they decode to its text.

    ``ids``, ``n_tokens`` and ``round_trip`` take the place of ``text`` and of columns of their names.
    """
    decoded = fresh(docs, "bpe_decoded")
    same = F.col(decoded) == F.coalesce("text", F.lit(""))
    return recode(docs, decoded=decoded).withColumn("round_trip", same).drop("text", decoded)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_copies), ("source_mix", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what only a stage needed is removed after it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        with scoped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
