"""What must hold for tables of any size: no side of a join is broadcast by a wrong estimate, and rows that grow are dealt first."""

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from kindler import plans


def plan_of(spark, name):
    return plans.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j14_raster_sample", "j14_raster_sample_clamped"])
def test_sampled_rasters_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


def test_tasks_of_a_sampled_raster_follow_its_pixels(spark, monkeypatch):
    """Ten times as many pixels as a task takes are sorted by ten tasks, whatever spark.sql.shuffle.partitions; points at one edge pixel meet it once."""
    from kindler import session
    from kindler.operators import spatial

    monkeypatch.setattr(session, "DEALT", 200, raising=False)
    seen = []
    monkeypatch.setattr(spatial, "checkpointed", lambda df, keep=spatial.checkpointed: seen.append(df.rdd.getNumPartitions()) or keep(df))
    pixels = spark.range(2_000).selectExpr("id DIV 50 AS row", "id % 50 AS col", "CAST(id AS DOUBLE) AS v")
    points = spark.range(3_000).selectExpr("id", "IF(id = 7, 20.5D, 1e6D) AS x", "IF(id = 7, 29.5D, -1e6D) AS y")
    got = {r["id"]: r["v"] for r in spatial.sample_raster(points, pixels, 0.0, 40.0, 1.0, 40, 50, clamp=True).collect()}
    assert got == {i: 10.0 * 50 + 20 if i == 7 else 1999.0 for i in range(3_000)} and seen == [10]


def test_lines_are_dealt_before_they_become_pixels(spark, tmp_path):
    from kindler.plans.tables import Tables

    spark.range(12_000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t.pixels().rdd.getNumPartitions() == 3 and t.pixels().select("row").distinct().count() == 12_000


def test_tasks_of_a_mosaic_follow_its_pixels(spark, monkeypatch):
    from kindler import session
    from kindler.operators import raster

    monkeypatch.setattr(session, "DEALT", 200, raising=False)
    tiles = spark.range(2_000).selectExpr("id DIV 50 AS row", "id % 25 AS col", "CAST(id AS DOUBLE) AS v", "id % 50 DIV 25 AS pri")
    made = raster.mosaic(tiles, "pri", (0, 39, 0, 24))
    assert made.rdd.getNumPartitions() == 10
    assert {(r["row"], r["col"]): r["v"] for r in made.collect()} == {(i, k): i * 50.0 + 25 + k for i in range(40) for k in range(25)}


@pytest.mark.parametrize("name", ["ras2_resample_nearest", "ras2_resample_bilinear"])
def test_resampled_rasters_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


def test_few_edges_are_paired_without_cells(spark):
    from kindler.operators import repair
    from kindler.operators.perimeters import numbered

    ring = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    rows = numbered(spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>"), "_r")
    edges = repair.ring_edges(rows)
    assert {r["n"] for r in edges.collect()} == {4}
    assert "Broadcast" not in repair._cuts(edges)._jdf.queryExecution().executedPlan().toString()


def test_boundary_distances_make_no_row_for_a_pair(spark):
    plan = plan_of(spark, "geo6_boundary_distance")
    assert "CoGroups" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", [None, 60])
def test_fire_histories_make_no_row_for_a_cell_and_a_perimeter(spark, monkeypatch, most):
    """Nothing kept is longer than the points or the edges, however many perimeters are in reach; blocks of very many are dealt in shares."""
    from kindler.operators import perimeters

    if most:
        monkeypatch.setattr(perimeters, "MOST", most, raising=False)
    seen = []
    monkeypatch.setattr(perimeters, "checkpointed", lambda df, keep=perimeters.checkpointed: seen.append((d := keep(df)).count()) or d)
    points = spark.range(300).selectExpr("id", "(id * 7919 % 20000) + 0.5D AS x", "(id * 5351 % 20000) + 0.5D AS y")
    box = lambda x, y: f"struct((id * 37 % 20000 + {x}) * 1D AS x, (id * 91 % 20000 + {y}) * 1D AS y)"
    shapes = spark.range(100).selectExpr("id AS pid", "2014 AS yr", f"array(array(array({box(0, 0)}, {box(900, 0)}, {box(900, 900)}, {box(0, 900)}))) AS parts")
    made = {r["id"]: r for r in perimeters.perimeter_features(points, shapes, "id", 2023).collect()}
    assert max(seen) <= 500  # 421 cells of edges for points with none within reach
    for i in range(300):
        x, y = i * 7919 % 20000 + 0.5, i * 5351 % 20000 + 0.5
        own = [(x - 450 - k * 37 % 20000, y - 450 - k * 91 % 20000) for k in range(100)]
        gap = [np.hypot(max(abs(u) - 450, 0), max(abs(v) - 450, 0)) for u, v in own]
        line = [g or 450 - max(abs(u), abs(v)) for g, (u, v) in zip(gap, own, strict=True)]
        want = (min(line), line.index(min(line)), sum(g < 5000 for g in gap), sum(g < 10000 for g in gap), int(0 in gap))
        assert tuple(made[i])[1:6] == (pytest.approx(want[0]), *want[1:])
        assert made[i]["recency_score"] == pytest.approx(want[3] / 10)


@pytest.mark.parametrize("name", ["ras4_ras5_ras6_focal", "ras7_vegetation_fraction"])
def test_focal_means_join_and_broadcast_nothing(spark, name):
    plan = plan_of(spark, name)
    assert "Broadcast" not in plan and "Join" not in plan


def test_focal_windows_hold_no_whole_line(spark):
    """Lines of 1,500 pixels are cut into blocks; the squares reach over their borders and mirror at the edges."""
    from numpy.lib.stride_tricks import sliding_window_view

    from kindler.operators import raster

    v = np.random.RandomState(3).rand(1500, 5)
    px = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(1500) for j in range(5)], "row long, col long, v double")
    made = raster.focal_mean(px, 2, 1500, 5)
    want = sliding_window_view(np.pad(v, 2, mode="symmetric"), (5, 5)).mean(axis=(2, 3))
    got = np.zeros_like(v)
    for r in made.collect():
        got[r["row"], r["col"]] = r["m"]
    assert np.allclose(got, want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("_b#" in line for line in plan.splitlines() if "windowspecdefinition" in line and "RangeFrame" in line)


def test_tiles_are_labelled_many_at_once(spark, monkeypatch):
    """A task's step takes all tiles of a block: one call of the labelling for 32 x 4 tiles, not 128."""
    from kindler.operators import raster

    d = spark.range(512).selectExpr("id AS row", "explode(sequence(0L, 49L)) AS col").withColumn("v", F.expr("CAST((row * 13 + col * 7) % 5 < 3 AS INT)"))
    seen = []
    monkeypatch.setattr(raster, "checkpointed", lambda df, keep=raster.checkpointed: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    raster.components(d, 50, tile=16)
    keys = next(p for p in seen if "FlatMapGroupsInPandas" in p)
    assert "/ 512" in keys.replace("512.0", "512") and "/ 16" not in keys.replace("16.0", "16")


def test_tasks_of_components_follow_their_pixels(spark, monkeypatch):
    """Blocks, and the names that their labels get, are dealt over tasks by counted pixels; all lines are one patch here."""
    from kindler import session
    from kindler.operators import raster

    monkeypatch.setattr(session, "DEALT", 200, raising=False)
    seen = []
    monkeypatch.setattr(raster, "checkpointed", lambda df, keep=raster.checkpointed: seen.append(df.rdd.getNumPartitions()) or keep(df))
    d = spark.range(2_000).selectExpr("id DIV 50 AS row", "id % 50 AS col", "1 AS v")
    made = raster.components(d, 50, tile=16)
    assert seen[0] == 10 and made.rdd.getNumPartitions() == 10
    assert {(r["row"], r["col"], r["label"]) for r in made.collect()} == {(i, k, 0) for i in range(40) for k in range(50)}


def test_views_hold_ids_of_many_rows(spark, tmp_path):
    """The third power of an id leaves a long from 2,097,152 on; the values are those of whole numbers without an end."""
    from kindler.plans.tables import VIEWS, Tables

    ids = [0, 1, 12, 13, 2_097_151, 2_097_152, 7_199_999, 50_000_017]
    spark.createDataFrame([(i,) for i in ids], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    assert {r["building_id"]: r["dist"] for r in t("val").collect()} == {i: float((i * 7 + i**3 % 13) % 97) for i in ids}
    low = "building_id < 2097152"
    assert sorted(t("val").where(low).collect()) == sorted(t.sql(VIEWS["val"].replace("FROM part)", "FROM part WHERE p_partkey < 2097152)")).collect())


def test_few_rows_are_fitted_where_they_are(spark, monkeypatch):
    from kindler.operators import model

    seen = []
    monkeypatch.setattr(model, "weighted", lambda df, label, keep=model.weighted: seen.append(df.rdd.getNumPartitions()) or keep(df, label))
    d = spark.range(0, 12_000, 1, 4).selectExpr("id / 100.0D AS a", "id % 7 / 1.0D AS b", "CAST(id % 3 = 0 AS INT) AS y")
    model.fit(d, ["a", "b"], "y", trees=1, depth=2)
    monkeypatch.setattr(model, "FITTED", 2_000, raising=False)
    model.fit(d, ["a", "b"], "y", trees=1, depth=2)
    assert seen == [4, 6]


def test_explained_rows_are_dealt(spark):
    from kindler.operators import model, shapley

    d = spark.range(12_000).selectExpr("id / 100.0D AS a", "id % 7 / 1.0D AS b", "CAST(id % 3 = 0 AS INT) AS y").coalesce(1)
    m = model.fit(d, ["a", "b"], "y", trees=1, depth=2)
    assert shapley.explained(m, d, ["a", "b"]).rdd.getNumPartitions() == 3


def test_boosting_holds_a_byte_for_a_value():
    import tracemalloc

    from kindler.operators import boosting

    r = np.random.RandomState(1)
    columns, y = [r.rand(300_000) for _ in range(4)], (r.rand(300_000) < 0.3).astype(float)
    tracemalloc.start()
    try:
        boosting.fit(columns, y, trees=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not columns and most < 300_000 * 90


def test_companions_are_found_by_a_task(spark, tmp_path):
    from kindler.sources import parts

    for n in ("a_metrics.json", "a_scores.csv", "b_metrics.json", "c_scores.csv"):
        (tmp_path / n).write_text("")
    assert [r["stem"] for r in parts.with_companion(spark, str(tmp_path)).collect()] == ["a"]
    assert "MapInArrow" in plan_of(spark, "src16_events_with_files")


def test_rounds_are_computed_by_several_tasks(spark, monkeypatch):
    from kindler.operators import scoring

    seen = []
    monkeypatch.setattr(scoring, "_cuts", lambda df, cols, draws, n, most: seen.append(df.rdd.getNumPartitions()) or [0.0] * len(draws))
    d = spark.range(50_000).selectExpr("id", "id / 50000.0D AS a", "1 - id / 50000.0D AS b").coalesce(1)
    scoring.weight_stability(d, "id", {"a": 0.5, "b": 0.5}, rounds=2)
    assert seen == [3]
