"""Backtest metrics over a labelled frame (burned, composite_score, baseline_score, risk_class, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats


def class_stats(df: DataFrame, classes: int = 5) -> DataFrame:
    """risk_class, n, n_burned, burned_rate for every class, empty ones too."""
    spine = df.sparkSession.range(1, classes + 1).select(F.col("id").cast("int").alias("risk_class"))
    g = df.groupBy("risk_class").agg(F.count("*").alias("n"), F.sum(F.col("burned").cast("long")).alias("b"))
    d = spine.join(F.broadcast(g), "risk_class", "left")
    return d.select("risk_class", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("b", F.lit(0)).cast("long").alias("n_burned"), F.coalesce(F.try_divide("b", "n"), F.lit(0.0)).alias("burned_rate"))


def class_metrics(df: DataFrame) -> DataFrame:
    """One row: precision in class 5 (null if empty) and recall in classes 4 and 5."""
    burned = F.col("burned").cast("long")
    return df.agg(
        F.count_if(F.col("risk_class") == 5).alias("n_cls5"),
        F.avg(F.when(F.col("risk_class") == 5, burned.cast("double"))).alias("precision_cls5"),
        (F.sum(F.when(F.col("risk_class").isin(4, 5), burned).otherwise(0)) / F.greatest(F.sum(burned), F.lit(1))).alias("recall_cls45"),
    )


def mean_scores(df: DataFrame, scores: list[str]) -> DataFrame:
    return df.groupBy(F.col("burned").cast("int").alias("burned")).agg(*[F.avg(s).alias(s) for s in scores])


def zones(df: DataFrame, lat: str, split: float) -> DataFrame:
    """zone, n, n_burned, auc_model, auc_baseline; AUC needs two rows of each class."""
    d = df.withColumn("zone", F.when(F.col(lat) < split, "south").otherwise("north"))
    m = stats.auc(d, "burned", "composite_score", ["zone"], least=2)
    b = stats.auc(d, "burned", "baseline_score", ["zone"], least=2).select("zone", F.col("auc").alias("auc_baseline"))
    return m.join(b, "zone").select("zone", "n", F.col("n_pos").alias("n_burned"), F.col("auc").alias("auc_model"), "auc_baseline")


def failures(df: DataFrame, key: str, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(burned rows of classes 1-2 with the lowest scores, unburned rows of classes 4-5 with the highest)."""
    burned = F.col("burned").cast("int")
    fn = df.where((burned == 1) & (F.col("risk_class") <= 2)).orderBy("composite_score", key).limit(n)
    fp = df.where((burned == 0) & (F.col("risk_class") >= 4)).orderBy(F.col("composite_score").desc(), key).limit(n)
    return fn, fp


def metrics(df: DataFrame, key: str = "building_id", rounds: int = 0) -> DataFrame:
    """One row of headline metrics; with ``rounds`` also bootstrap intervals."""
    d = df.withColumn("_all", F.lit(1))
    out = df.agg(F.count("*").alias("n"), F.sum(F.col("burned").cast("long")).alias("n_burned"), F.avg(F.col("burned").cast("double")).alias("prevalence"))
    for name, score in (("model", "composite_score"), ("baseline", "baseline_score")):
        a = stats.auc(df, "burned", score).select(F.col("auc").alias(f"auc_{name}"))
        lift = stats.lift_at(df, "burned", score, key).select(F.col("lift").alias(f"lift_{name}"))
        out = out.crossJoin(a).crossJoin(lift)  # single rows
        if rounds:
            ci = stats.bootstrap_auc(d, "burned", score, "_all", rounds).select(F.col("low").alias(f"auc_{name}_low"), F.col("high").alias(f"auc_{name}_high"))
            out = out.crossJoin(ci)
    out = out.crossJoin(class_metrics(df))
    return out.withColumns({"auc_delta": F.col("auc_model") - F.col("auc_baseline"), "lift_delta": F.col("lift_model") - F.col("lift_baseline")})
