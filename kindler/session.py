"""Session defaults that suit both a laptop and a large cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kindler", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; anything in ``conf`` (with ``_`` for ``.``) wins."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder, or below the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int = 5_000) -> DataFrame:
    """``df`` dealt over tasks of ``rows`` rows; Spark deals files by their bytes, so few tasks would get what is small in a file and much once it is computed."""
    return df.repartition(max(1, -(-df.count() // rows)))


#: Rows of a task of ``dealt``.
DEALT = 1_000_000


def dealt(*sides: DataFrame, keys: list[str]) -> list[DataFrame]:
    """``sides`` dealt by ``keys`` over as many tasks as the largest has millions of rows, so that what a task sorts or groups does not grow with them.

    They meet on ``keys`` without another shuffle.  The number of tasks is kept, so no key may have very many rows.
    """
    tasks = max(1, *(-(-d.count() // DEALT) for d in sides))
    return [d.repartition(tasks, *keys) for d in sides]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut; a folder in the warehouse only where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()
