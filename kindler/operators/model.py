"""Leave-one-event-out gradient-boosted trees."""

from __future__ import annotations

import pickle
import sys

from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from . import boosting
from .stats import counted, ranked_auc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library


#: ML7: 21 structural and 5 dynamic features; leaving one event out drops the five of fire history, which know the event itself.
FIRE_HISTORY = ["dist_to_nearest_fire_m", "fire_count_5km", "fire_count_10km", "firms_hotspot_count_5km", "recency_score"]
STRUCTURAL = [
    "elevation_m", "slope_deg", "south_aspect_score", "tpi_300m", "tri_300m",
    "veg_fraction_100m", "veg_fraction_500m", "dist_to_forest_m", "dist_to_scrubland_m", "wui_class", "veg_continuity_500m",
    "fwi_season_mean", "fwi_season_p90", "fwi_season_max", "dc_season_mean", "fwi_extreme_days", *FIRE_HISTORY,
]
DYNAMIC = ["wind_speed_max_24h", "wind_dir_consistency", "vpd_event_day", "dc_antecedent_30d", "fwi_event_day"]
ALL = STRUCTURAL + DYNAMIC
LEAVE_ONE_OUT = [f for f in ALL if f not in FIRE_HISTORY]


def weighted(df: DataFrame, label: str) -> DataFrame:
    """``df`` with class weights that give both classes the same mass."""
    n = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    pos, total = float(n["p"] or 0), float(n["n"])
    return df.withColumn("_w", F.when(F.col(label) == 1, F.lit(total / max(2 * pos, 1.0))).otherwise(F.lit(total / max(2 * (total - pos), 1.0))))


#: Rows of a task of ``fit``, at most; rows in more tasks stay where they are.
FITTED = 100_000


def fit(df: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 42) -> PipelineModel:
    """Imputation by medians, then boosted trees on 0.8 of the rows and features each, with 20 rows in a leaf or more."""
    filled = [f"_f_{f}" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x"), GBTClassifier(labelCol=label, featuresCol="_x", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=seed)]
    cast = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label))
    tasks = -(-cast.count() // FITTED)
    if tasks > cast.rdd.getNumPartitions():
        # rows are drawn, and paired with their predictions, by their place in a task: it must not depend on which rows came first
        cast = cast.repartition(tasks).sortWithinPartitions(*features, label)
    return Pipeline(stages=stages).fit(weighted(cast, label))


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str = "probability_burned") -> DataFrame:
    d = df.select("*", *[F.col(f).cast("double").alias(f"_c_{f}") for f in features])
    d = d.select([c for c in df.columns if c not in features] + [F.col(f"_c_{f}").alias(f) for f in features])
    made = model.transform(d)
    return made.select(*d.columns, vector_to_array("probability")[1].alias(out))


#: Values (rows x features) that the task which fits one event's model holds at most; beyond, every model is fitted by Spark ML.
HELD = 40_000_000


def leave_one_out(df: DataFrame, event: str, features: list[str], label: str, **params) -> DataFrame:
    """Predictions for every event by a model of all the others; events are few.

    Each model is fitted on all rows of the other events by one task, the models
    of all events at once.
    """
    sizes = {r[0]: r[1] for r in df.where(F.col(event).isNotNull()).groupBy(event).count().collect()}
    events = sorted(sizes)
    if len(events) < 2:
        raise ValueError(f"{event} has {len(events)} values: no other event to learn from")
    if (sum(sizes.values()) - min(sizes.values())) * len(features) > HELD:
        return _one_by_one(df, events, event, features, label, **params)
    index = (F.array_position(F.array(*[F.lit(e) for e in events]), F.col(event)) - 1).cast("int")
    rows = df.where(F.col(event).isNotNull()).select(index.alias("_e"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_y"))
    others = rows.where("_y is not null").select(F.explode(F.array_remove(F.array(*[F.lit(k) for k in range(len(events))]), F.col("_e"))).alias("_m"), *rows.columns[1:])
    models = {r["_m"]: pickle.loads(r["model"]) for r in others.repartitionById(len(events), F.col("_m")).mapInArrow(_fitting(len(features), params), "_m int, model binary").collect()}
    if len(models) < len(events):
        raise ValueError(f"no labelled rows to learn from for {[e for i, e in enumerate(events) if i not in models]}")
    d = spread(df.where(F.col(event).isNotNull()), 20_000).select(*[c for c in df.columns if c not in features], *[F.col(f).cast("double").alias(f) for f in features], index.alias("_e"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.drop("_e").schema)
    return d.mapInArrow(_scoring(models, features, d.columns[:-1]), f"{schema}, probability_burned double")


def _matrix(table, columns: list[str]):
    """The columns as doubles side by side, missing values as NaN."""
    import numpy as np
    import pyarrow.compute as pc

    return np.stack([pc.fill_null(table.column(c), float("nan")).to_numpy(zero_copy_only=False) for c in columns], axis=1) if columns else np.zeros((table.num_rows, 0))


def _fitting(n: int, params: dict):
    """Batches of one model's rows (_m, _0 to _<n - 1>, _y) to the model."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, of = [f"_{i}" for i in range(n)], None
        parts: list = [[] for _ in range(n + 1)]
        for b in batches:
            if b.num_rows:
                of = b.column("_m")[0].as_py()
                for own, c in zip(parts, [*_matrix(b, names).T, b.column("_y").to_numpy()], strict=True):
                    own.append(c.copy())  # nothing of the batch is kept
        if of is not None:
            columns = []
            while parts:
                columns.append(np.concatenate(parts.pop(0)))
            y = columns.pop()
            model = boosting.fit(columns, y, **params)
            parts = (model.feature, model.threshold, model.value, model.base, model.fill)
            yield pa.record_batch([pa.array([of], pa.int32()), pa.array([pickle.dumps(parts)], pa.binary())], names=["_m", "model"])

    return run


def _scoring(models: dict, features: list[str], columns: list[str]):
    """Batches with the event's number ``_e`` to the same rows with the probability of that event's model."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trees = {k: boosting.Trees(*m) for k, m in models.items()}
        for b in batches:
            x, e, out = _matrix(b, features), b.column("_e").to_numpy(), np.zeros(b.num_rows)
            for k in np.unique(e):
                out[e == k] = trees[k].score(x[e == k])
            yield pa.record_batch([*(b.column(c) for c in columns), pa.array(out)], names=[*columns, "probability_burned"])

    return run


def _one_by_one(df: DataFrame, events: list, event: str, features: list[str], label: str, **params) -> DataFrame:
    """The same with models whose rows no task holds, fitted one after another."""
    done = None
    for e in events:
        model = fit(df.where(F.col(event) != e), features, label, **params)
        part = predict(model, df.where(F.col(event) == e), features)
        done = part if done is None else done.unionByName(part)
    return done


def event_metrics(predicted: DataFrame, event: str, label: str, new: str, old: str) -> DataFrame:
    """event, AUC of both scores and their difference, rounded to four places.

    The predictions are made once, and both scores are ranked together.
    """
    given = predicted.where(F.col(event).isNotNull() & F.col(label).isNotNull())
    both = given.select(event, label, F.inline(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(c).alias("_score")) for i, c in enumerate((new, old))])))
    a = ranked_auc(checkpointed(counted(both, label, "_score", [event, "_of"])), "_score", [event, "_of"])
    pick = lambda i, out: F.round(F.max(F.when(F.col("_of") == i, F.col("auc"))), 4).alias(out)
    a = a.groupBy(event).agg(pick(0, "auc_v2"), pick(1, "auc_v1"), F.count("*").alias("_n")).where("_n = 2").drop("_n")
    return a.withColumn("delta", F.round(F.col("auc_v2") - F.col("auc_v1"), 4))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Gain importance by feature, largest first (mean absolute SHAP has no built-in counterpart)."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))
