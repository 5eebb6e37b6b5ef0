"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame with the columns of documents.

Whatever other columns ``docs`` has travel in one struct, so their names cannot
clash with those of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, quality_gbt, signature_join, suffix_dedup
from .common import table


def others(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])


def rebuilt(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of documents from ``carry`` and ``text``, n_chars counted anew if it is there."""
    def value(c):
        if c == "text":
            return F.col(text).alias(c)
        if c == "n_chars":
            return F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c)
        return F.col(f"carry.`{c}`").alias(c)

    return rows.select(*[value(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below 0.7."""
    model = quality_gbt.train(docs, table(spark, sf_dir, "labels"), "quality", modulus=4, held_out=2)
    scored = quality_gbt.classify(docs.select(others(docs).alias("carry"), "text"), model, threshold=0.7, keep=("carry", "text"))
    kept = scored.where("predicted = 1")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest doc_id, of those the smallest row key.

    Groups are linked texts, whatever their ids: rows that share an id but not
    their text are judged apart, and rows without an id come after those with one.
    Texts without words are no copies of each other; of rows that repeat both id
    and text one stays.
    """
    stay = signature_join.representatives(docs, 5, 80)
    rows = docs.withColumn("_stage_key", F.xxhash64("doc_id", "text"))
    rows = rows.join(stay.select(F.col("row_key").alias("_stage_key")), "_stage_key", "left_semi").dropDuplicates(["_stage_key"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 35 words or more that occur elsewhere too; texts without any stay as they are."""
    found = suffix_dedup.dedup(docs, 35, carry=others(docs), verbatim=True)
    return rebuilt(found.select("carry", F.col("kept").alias("text")), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten consecutive words of a benchmark item."""
    found = decontaminate.phrase_matches(docs, table(spark, sf_dir, "benchmark"), carry=others(docs))
    clean = found.where(F.size("spans") == 0)
    return clean.select(*[F.col("text") if c == "text" else F.col(f"carry.`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0), 2048)
