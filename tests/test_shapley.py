"""Shapley values of trees against the definition."""

import itertools
import math
import random

import numpy as np
import pytest

from kindler.operators import model, shapley


def expectation(tree, x, known, node=0):
    """The tree's value for a row of which only some features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expectation(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    return sum(tree.cover[c] / tree.cover[node] * expectation(tree, x, known, c) for c in (left, right))


def by_definition(tree, x):
    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                out[i] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (expectation(tree, x, {*s, i}) - expectation(tree, x, set(s)))
    return out


def grown(r, depth, features):
    """A random tree: some branches end early, features repeat along paths."""
    nodes: list = []

    def grow(level, cover):
        me = len(nodes)
        nodes.append(None)
        if level == depth or cover < 2 or r.random() < 0.15:
            nodes[me] = (-1, 0.0, -1, -1, r.uniform(-2, 2), cover)
            return me
        part = r.randint(1, int(cover) - 1) if cover >= 2 else 1
        f, t = r.randrange(features), r.random()
        left, right = grow(level + 1, float(part)), grow(level + 1, cover - part)
        nodes[me] = (f, t, left, right, 0.0, cover)
        return me

    grow(0, 50.0)
    return shapley.Tree(*zip(*nodes, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_values_equal_the_definition(seed):
    r = random.Random(seed)
    tree = grown(r, 6, 4)
    x = np.array([[r.random() for _ in range(4)] for _ in range(20)])
    got = shapley.values([tree], [1.0], x)
    assert got == pytest.approx(np.array([by_definition(tree, row) for row in x]))
    assert got.sum(axis=1) + tree.base == pytest.approx([expectation(tree, row, {0, 1, 2, 3}) for row in x])


def test_a_fitted_model_adds_up(spark):
    r = random.Random(3)
    rows = [(i, r.random(), r.random() if i % 7 else None, float(r.randint(0, 5)), 0.5) for i in range(500)]
    d = spark.createDataFrame([(*x, int((x[1] > 0.6) != (x[3] > 3))) for x in rows], "id int, a double, b double, c double, e double, y int")
    m = model.fit(d, ["a", "b", "c", "e"], "y", trees=8, depth=4)
    made = {x["id"]: x for x in shapley.explained(m, d.select("id", "a", "b", "c", "e"), ["a", "b", "c", "e"]).collect()}
    for p in model.predict(m, d, ["a", "b", "c", "e"]).collect():
        odds = made[p["id"]]["expected"] + sum(made[p["id"]]["shap"])
        assert 1 / (1 + math.exp(-odds)) == pytest.approx(p["probability_burned"])
    mean = {x["feature"]: x["mean_abs_shap"] for x in shapley.mean_importances(m, d, ["a", "b", "c", "e"]).collect()}
    assert mean == pytest.approx({f: np.mean([abs(x["shap"][i]) for x in made.values()]) for i, f in enumerate(["a", "b", "c", "e"])})
    assert mean["e"] == 0.0 < mean["b"] < mean["a"]
    assert shapley.mean_importances(m, d.where("false"), ["a", "b", "c", "e"]).where("mean_abs_shap = 0").count() == 4


def test_a_scoring_run_writes_only_what_holds(spark, tmp_path):
    from kindler.operators import scoring

    r = random.Random(5)
    d = spark.createDataFrame([(i, r.random(), r.random() if i % 3 else None, 4.0, None) for i in range(500)], "id int, a double, b double, flat double, empty double")
    groups = {"one": {"a": "positive", "b": "negative"}, "two": {"flat": "positive", "empty": "positive"}, "three": {"gone": "positive", "a": "negative"}}
    weights = {"one": 0.6, "two": 0.2, "three": 0.2}
    path = str(tmp_path / "scores")
    scores, checks = scoring.scoring_run(d, "id", groups, weights, path, ("composite_score", "one"), least_rows=500)
    assert scores.columns == ["id", "one", "three", "composite_score", "risk_class"] and scores.count() == 500
    x = scores.where("id = 1").first()
    assert x["composite_score"] == pytest.approx(0.75 * x["one"] + 0.25 * x["three"])
    assert checks.where("not ok").count() == 0 and {c["check"] for c in checks.collect()} == {"rows", "nulls", "at least 0", "at most 1", "share", "correlation"}
    with pytest.raises(ValueError, match="rows of all"):
        scoring.scoring_run(d.where("id < 100"), "id", groups, weights, path, ("composite_score", "one"), least_rows=500)
    assert spark.read.parquet(path).count() == 500  # the table before stays
    with pytest.raises(ValueError, match="no group"):
        scoring.scoring_run(d, "id", {"two": groups["two"]}, weights, path, ("composite_score", "two"))
