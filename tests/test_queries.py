import pytest

from helpers import SMALL, same_rows
from kindler import plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(plans.queries()[name](spark, SMALL), duck, plans.oracle_sql()[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["j9_radius_self_count", "j10_radius_count", "w1_percentile_rank", "stat1_auc_by_event"])
def test_no_cross_product(spark, name):
    df = plans.queries()[name](spark, SMALL)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j8_nearest_by_grid", "j10_radius_count", "ras8_class_distance", "ras10_continuity"])
def test_every_id_has_a_row(spark, tmp_path, name):
    spark.range(1, 901).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 301).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = [r["id"] for r in plans.queries()[name](spark, str(tmp_path)).select("id").collect()]
    assert sorted(got) == list(range(1, 901))


def test_registered_risk_jobs_are_whole(spark, monkeypatch):
    from kindler.operators import model, scoring, stats

    seen = []
    for module, name in ((stats, "bootstrap_auc"), (scoring, "weight_stability"), (model, "leave_one_out"), (model, "fit")):
        monkeypatch.setattr(module, name, lambda *a, _n=name, **k: seen.append((_n, k)) or 1 / 0)
    for name in ("stat2_bootstrap_interval", "stat5_weight_sensitivity", "ml2_ml3_leave_one_event_out", "ml5_event_metrics", "ml4_ml6_importances"):
        with pytest.raises(ZeroDivisionError):
            plans.queries()[name](spark, SMALL)
    trees = {"trees": 200, "depth": 6}
    assert seen == [("bootstrap_auc", {"rounds": 1000}), ("weight_stability", {"rounds": 500}), ("leave_one_out", trees), ("leave_one_out", trees), ("fit", trees)]


def test_stability_of_500_draws(spark):
    import numpy as np

    from kindler.operators import scoring
    from kindler.plans.risk import WEIGHTS

    x = np.random.RandomState(1).rand(200, 4)
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "building_id long, " + ", ".join(f"{c} double" for c in WEIGHTS))
    got = {r["building_id"]: r["stability"] for r in scoring.weight_stability(d, "building_id", WEIGHTS).collect()}
    scores = x @ np.array(scoring.weight_draws(WEIGHTS)).T
    share = (scores >= np.sort(scores, axis=0)[-20]).mean(axis=1)
    top = np.argsort(-(x @ np.array(list(WEIGHTS.values()))))[:20]
    assert got == pytest.approx({int(i): share[i] for i in top})
