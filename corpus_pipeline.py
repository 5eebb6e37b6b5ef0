"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works
on all that its predecessor kept.  Every stage's result is written and read
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindler.llm import common, stages

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("substring dedup", stages.substring_dedup),
    ("benchmark decontamination", stages.benchmark_decontamination),
    ("best-fit packing", stages.best_fit_packing),
]

#: The first and the last stage can't be expressed in SQL; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
