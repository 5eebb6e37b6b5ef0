"""Scans and sinks over the formats that Spark reads itself."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet with a projection; only those columns are read. A folder of chunks is their union."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header; names are checked against the schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def scan_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Whole JSON documents (metrics, feature collections), or one object a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def time_of(df: DataFrame) -> DataFrame:
    """A grid table whose time column is called ts, whatever the source calls it (ts, valid_time, time)."""
    have = [c for c in ("ts", "valid_time", "time") if c in df.columns]
    if not have:
        raise ValueError("no time column")
    return df.withColumnRenamed(have[0], "ts")


def with_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with missing columns as nulls and all of ``schema`` cast, other columns kept behind."""
    known = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
    return df.select(*known, *[c for c in df.columns if c not in schema])


def events_with_companion(spark: SparkSession, folder: str, main: str = "_metrics.json", other: str = "_scores.csv") -> list[str]:
    """Stems in ``folder`` that have both files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    stems = {n[: -len(main)] for n in names if n.endswith(main)}
    return sorted(s for s in stems if s + other in names)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The Parquet table at ``path``; made first if it is missing or ``force`` is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Drops and creates the table ``name``."""
    df.write.mode("overwrite").option("overwriteSchema", True).saveAsTable(name)
    return df.sparkSession.table(name)


def upsert_events(df: DataFrame, path: str, key: str = "event_id") -> DataFrame:
    """Replaces the rows of the events that ``df`` has, and keeps the others (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return df.sparkSession.read.parquet(path)


def load_ordered(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return replace_table(df.select(*columns), name)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """One CSV file with a header, for reports; doubles with ``decimals`` places if given."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def map_payload(df: DataFrame, lat: str = "centroid_lat", lon: str = "centroid_lon", places: int = 4) -> DataFrame:
    """risk_class, payload: JSON array of [lat, lon] pairs of each class and slice; slices keep any one payload bounded."""
    sized = df.withColumn("slice", F.pmod(F.xxhash64(lat, lon), F.lit(64)).cast("int"))
    return sized.groupBy("risk_class", "slice").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.round(lat, places), F.round(lon, places))))).alias("payload"))


def report(title: str, sections: list[tuple[str, DataFrame]], limit: int = 50) -> str:
    """Markdown with a table for each section of at most ``limit`` rows."""
    out = [f"# {title}", ""]
    for name, df in sections:
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(limit).collect()]
        out.append("")
    return "\n".join(out)


def manifest(spark: SparkSession, path: str, **facts) -> DataFrame:
    """One row of provenance, written as JSON."""
    df = spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)
    return df
