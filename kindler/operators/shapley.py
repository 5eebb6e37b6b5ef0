"""Shapley values of boosted trees, by the leaves' paths.

A leaf counts for a row by the share of training rows that would reach it if only
some features were known: known features let the row through or not, unknown ones
let through the share that training rows had.  A feature's Shapley value is its
mean effect over all orders in which features become known.  A path has few
different features, so for each leaf the values of all patterns of "lets this row
through" are tabulated once, by the coefficients of the polynomial prod(z + o t)
over the other features; a row then reads its pattern's values.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

#: Features of one path, at most: a leaf's table has 2**n rows.
WIDEST = 12


class Tree:
    """Nodes in arrays: feature (-1 in leaves), threshold (rows at or below go left), children, value, and the weight of training rows that reached it."""

    def __init__(self, feature, threshold, left, right, value, cover):
        self.feature, self.threshold, self.left, self.right, self.value, self.cover = (np.asarray(v) for v in (feature, threshold, left, right, value, cover))
        self.inner = np.flatnonzero(self.feature >= 0)
        place = {int(n): i for i, n in enumerate(self.inner)}
        self.leaves, self.base = [], 0.0
        stack: list = [(0, [], 1.0)]
        while stack:
            node, path, share = stack.pop()
            if self.feature[node] < 0:
                self.base += share * self.value[node]
                if path:
                    self.leaves.append(self._leaf(path, float(self.value[node])))
                continue
            total = self.cover[node]
            for child, down in ((self.left[node], True), (self.right[node], False)):
                part = float(self.cover[child] / total) if total > 0 else 0.5
                stack.append((int(child), [*path, (int(self.feature[node]), place[node], down, part)], share * part))

    @staticmethod
    def _leaf(path: list, value: float):
        """(features of the path, their conditions, values by pattern and feature)."""
        own = sorted({p[0] for p in path})
        d = len(own)
        if d > WIDEST:
            raise ValueError(f"a path has {d} features, more than {WIDEST}")
        z = [math.prod(p[3] for p in path if p[0] == f) for f in own]
        conditions = [[(p[1], p[2]) for p in path if p[0] == f] for f in own]
        weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        table = np.zeros((2**d, d))
        for pattern in range(2**d):
            on = [pattern >> i & 1 for i in range(d)]
            for i in range(d):
                c = [1.0]
                for j in range(d):
                    if j != i:
                        c = [(c[k] * z[j] if k < len(c) else 0.0) + (c[k - 1] * on[j] if k else 0.0) for k in range(len(c) + 1)]
                table[pattern, i] = value * (on[i] - z[i]) * sum(w * x for w, x in zip(weight, c, strict=True))
        return own, conditions, table

    def add(self, x: np.ndarray, out: np.ndarray, scale: float) -> None:
        """Adds ``scale`` times the values of the rows of ``x`` to ``out``."""
        down = x[:, self.feature[self.inner]] <= self.threshold[self.inner]
        for own, conditions, table in self.leaves:
            pattern = np.zeros(len(x), np.int64)
            for i, rules in enumerate(conditions):
                on = np.ones(len(x), bool)
                for place, left in rules:
                    on &= down[:, place] == left
                pattern |= on.astype(np.int64) << i
            out[:, own] += scale * table[pattern]


def values(trees: list, weights: list[float], x: np.ndarray) -> np.ndarray:
    """Shapley value of every feature for every row; with the weighted bases they add up to the trees' sum."""
    out = np.zeros(x.shape)
    for tree, w in zip(trees, weights, strict=True):
        tree.add(x, out, w)
    return out


def trees_of(model) -> tuple[list, list[float]]:
    """(trees, weights) of a fitted Spark ML ensemble, read from its saved form: at most a few thousand nodes for each tree."""
    spark = SparkSession.getActiveSession()
    path = scratch(spark, "model")
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = n.select("treeID", "id", "prediction", F.col("impurityStats")[0].alias("cover"), "leftChild", "rightChild", "split.featureIndex", F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold")).orderBy("treeID", "id").collect()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    by: dict = {}
    for r in rows:
        by.setdefault(r["treeID"], []).append(r)
    trees = []
    for _, own in sorted(by.items()):
        at = {r["id"]: i for i, r in enumerate(own)}
        trees.append(Tree([r["featureIndex"] for r in own], [r["threshold"] if r["threshold"] is not None else 0.0 for r in own], [at.get(r["leftChild"], -1) for r in own], [at.get(r["rightChild"], -1) for r in own], [r["prediction"] for r in own], [r["cover"] for r in own]))
    return trees, [float(w) for w in model.treeWeights]


def explained(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` without ``features`` as given, with ``shap`` (a value for each of ``features``, in their order) and ``expected``.

    Values explain the log-odds of the positive class: ``expected`` and the values
    of a row add up to them.  Missing features are filled as the model fills them.
    The trees travel with the task; rows are read once.
    """
    trees, weights = trees_of(model.stages[-1])
    base = 2 * sum(w * t.base for w, t in zip(weights, trees, strict=True))
    filled = [f"_f_{f}" for f in features]
    cast = df.select(*[c for c in df.columns if c not in features], *[F.col(f).cast("double").alias(f) for f in features])
    rows = model.stages[0].transform(spread(cast)).drop(*features)
    keep = [c for c in rows.columns if c not in filled]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "shap array<double>", "expected double"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in filled], axis=1)
                made = 2 * values(trees, weights, x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, x.shape[1]), pa.int32()), pa.array(made.ravel()))
                yield pa.record_batch([*(part.column(c) for c in keep), flat, pa.array(np.full(part.num_rows, base))], names=[*keep, "shap", "expected"])

    return rows.select(*keep, *filled).mapInArrow(run, schema)


def mean_importances(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_abs_shap over the rows of ``df``, and the gain importance of the fit; all features, zeros included."""
    made = explained(model, df.select(*features), features)
    one = F.posexplode(F.transform("shap", F.abs))
    means = made.select(one.alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean_abs_shap"))
    gain = [(i, f, g) for i, (f, g) in enumerate(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))]
    names = df.sparkSession.createDataFrame(gain, "i int, feature string, gain double")  # a row for each feature
    return names.join(means, "i", "left").select("feature", F.coalesce("mean_abs_shap", F.lit(0.0)).alias("mean_abs_shap"), "gain")
