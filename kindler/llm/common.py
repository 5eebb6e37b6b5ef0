"""Shared plumbing: row keys, written tables, blob shuffles and components.

Row identity.  ``row_key = xxhash64(doc_id, text)`` is defined for nulls too;
rows that repeat both values share a key and therefore share an answer, rows
that repeat only the id are kept apart.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: list = []


def _drop_written() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and its folder with it
            return


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kindler-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input, as the optimizer estimates them, for which a bucket is added.
BUCKET_BYTES = 64 << 20


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame) -> int:
    """Number of buckets of a blob shuffle: the shuffle partitions, and more where the input asks for them, so a task's share stays bounded."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-size // BUCKET_BYTES) if size < 1 << 50 else 0)  # sizes beyond a petabyte mean unknown ones


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """row_key, doc_id and text (plus ``more``); other columns are left out, so their names cannot clash."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text", *more)


def split_by_bucket(bucket: np.ndarray, n: int, *columns: np.ndarray):
    """Yields (bucket, columns of its rows): one stable sort instead of n masks."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), [c[edges[b] : edges[b + 1]] for c in columns]


#: Rows of one key on one side of a ``hot_join`` that go to one cell.
HOT_ROWS = 2000


def hot_join(left: DataFrame, right: DataFrame, key: str, left_by: list[str], right_by: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, which may be hot on both sides; every pair of rows meets exactly once.

    A key with more than ``HOT_ROWS`` rows on a side is dealt to a grid of cells by
    hashes of ``left_by`` and ``right_by``, so no task needs all rows of a key.  The
    counts of the few hot keys are joined first; Spark broadcasts them only where
    their measured size allows.  ``counted``: rows with the keys of ``left``, where
    these are cheaper to count.  ``how="left"`` asks for a ``right`` that is unique by ``key``.
    """

    def cells(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(key).agg(F.ceil(F.count("*") / F.lit(HOT_ROWS)).cast("int").alias(name)).where(F.col(name) > 1)

    hot = cells(left if counted is None else counted, "_rows").join(cells(right, "_columns"), key, "full")

    def dealt(d: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        cell = F.pmod(F.xxhash64(*by), n).cast("int").alias("_at" + own)
        return d.join(hot, key, "left").select(*d.columns, cell, F.explode(F.sequence(F.lit(0), m - 1)).alias("_at" + other))

    met = dealt(left, left_by, "_rows", "_columns").join(dealt(right, right_by, "_columns", "_rows"), [key, "_at_rows", "_at_columns"], how)
    return met.drop("_at_rows", "_at_columns")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component = smallest node) of the undirected ``edges`` by alternating large-star and small-star.

    Nothing is gathered on the driver.  Hub nodes are pre-aggregated by ``min``
    before the shuffle; their adjacency is joined, which AQE can split.  Self
    loops keep a node in the result; null ends are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = written(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
