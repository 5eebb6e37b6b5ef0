"""Checks of tables and columns, and assertions that ride along with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def check_catalog(spark: SparkSession, required: dict[str, list[str]], not_null: dict[str, list[str]] | None = None) -> DataFrame:
    """check, subject, ok, detail: tables exist, have their columns, and key columns hold no null. Missing tables are reported, not raised."""
    have = {t.name for t in spark.catalog.listTables()}
    rows = []
    for t, columns in required.items():
        rows.append(("table", t, t in have, "" if t in have else "missing"))
        if t in have:
            missing = sorted(set(columns) - {c.name for c in spark.catalog.listColumns(t)})
            rows.append(("columns", t, not missing, ",".join(missing)))
    for t, columns in (not_null or {}).items():
        own = [c for c in columns if t in have and c in spark.table(t).columns]
        if own:
            counts = spark.table(t).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in own]).first()
            rows += [("nulls", f"{t}.{c}", counts[c] == 0, str(counts[c])) for c in own]
    return spark.createDataFrame(rows, "`check` string, subject string, ok boolean, detail string")


def unknown_columns(spark: SparkSession, table: str, required: list[str]) -> list[str]:
    """Required columns that the table lacks."""
    return sorted(set(required) - {c.name for c in spark.catalog.listColumns(table)})


def expecting(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, Observation]:
    """``df`` that counts violations of ``conditions`` while any action runs over it; read them from the observation."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]), seen


def asserted(df: DataFrame, condition, message: str) -> DataFrame:
    """``df`` whose evaluation fails on the first row without ``condition``."""
    return df.where(F.coalesce(F.assert_true(condition, message).cast("string"), F.lit("")) == "")


def score_checks(df: DataFrame, scores: list[str], klass: str, pair: tuple[str, str], least_rows: int = 80_000, share: tuple[float, float] = (0.18, 0.22), least_correlation: float = 0.3, classes: int = 5) -> DataFrame:
    """check, subject, ok, value: what must hold before scores are written, in one pass.

    Enough rows; no score null, below 0 or above 1; each class with its share of
    the rows; the two scores of ``pair`` correlated.
    """
    n = F.count("*")
    checks = [("rows", "all", n >= least_rows, n)]
    for c in scores:
        nulls, low, high = F.count_if(F.col(c).isNull()), F.min(c), F.max(c)
        checks += [("nulls", c, nulls == 0, nulls), ("at least 0", c, F.coalesce(low >= 0, F.lit(False)), low), ("at most 1", c, F.coalesce(high <= 1, F.lit(False)), high)]
    for k in range(1, classes + 1):
        part = F.try_divide(F.count_if(F.col(klass) == k), n)
        checks.append(("share", f"class {k}", F.coalesce(part.between(*share), F.lit(False)), part))
    r = F.corr(*pair)
    checks.append(("correlation", " and ".join(pair), F.coalesce(r > least_correlation, F.lit(False)), r))
    rows = F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("subject"), F.col(f"ok{i}").alias("ok"), F.col(f"v{i}").alias("value")) for i, (a, b, _, _) in enumerate(checks)])
    return df.agg(*[x for i, (_, _, ok, v) in enumerate(checks) for x in (ok.alias(f"ok{i}"), v.cast("double").alias(f"v{i}"))]).select(F.inline(rows))
