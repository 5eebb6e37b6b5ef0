"""Scores, classes, backtests, sensitivity, models and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model, quality, resample, scoring, shapley, stats, validation
from ..session import scratch
from .core import r6
from .tables import registry, with_views

Q, SQL, query = registry()

#: Weights of the four groups after the missing fifth one is shared out.
WEIGHTS = {"score_a": 1 / 3, "score_b": 2 / 9, "score_c": 2 / 9, "score_d": 2 / 9}


def _rank_sql(view: str, v: str, key: str, name: str, negative: bool = False) -> str:
    s = f"(r - 1) / (n - 1)"
    s = f"1 - {s}" if negative else s
    return (f"{name}_e AS (SELECT quantile_cont({v}, 0.01) AS lo, quantile_cont({v}, 0.99) AS hi FROM {view}), {name}_c AS (SELECT {key}, greatest(least({v}, hi), lo) AS c FROM {view}, {name}_e WHERE {v} IS NOT NULL), "
            f"{name}_r AS (SELECT {key}, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n FROM {name}_c), {name} AS (SELECT {key}, {s} AS s FROM {name}_r)")


@query(with_views("feat", more=_rank_sql("feat", "retail", "id", "a") + ", " + _rank_sql("feat", "price", "id", "b", True)) + " SELECT id, round(a.s, 6) AS pos, round(b.s, 6) AS neg FROM feat LEFT JOIN a USING (id) LEFT JOIN b USING (id)")
def w1_percentile_rank(t):
    d = stats.percentile_ranks(t("feat"), {"retail": "positive", "price": "negative"}, {"retail": "pos", "price": "neg"})
    return d.select("id", r6("pos", "pos"), r6("neg", "neg"))


@query(with_views("val", more="raw AS (SELECT building_id, 1.0::DOUBLE / (dist + 1) AS v FROM val), " + _rank_sql("raw", "v", "building_id", "a")) + " SELECT building_id, round(s, 6) AS baseline_score FROM a")
def w2_baseline(t):
    return scoring.baseline(t("val"), "dist").select("building_id", r6("baseline_score", "baseline_score"))


_EDGES = "e AS (SELECT quantile_cont(s, 0.2) AS a, quantile_cont(s, 0.4) AS b, quantile_cont(s, 0.6) AS c, quantile_cont(s, 0.8) AS d FROM z)"


@query(with_views("feat") + ", z AS (SELECT id, retail AS s FROM feat), " + _EDGES + " SELECT id, CAST(1 + (s > a)::INT + (s > b)::INT + (s > c)::INT + (s > d)::INT AS INTEGER) AS risk_class FROM z, e")
def w3_quintile_class(t):
    return stats.quantile_class(t("feat"), "retail").select("id", "risk_class")


@query(with_views("val") + " SELECT building_id, rank() OVER (ORDER BY composite_score) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2.0::DOUBLE AS rank FROM val")
def w4_average_rank(t):
    return stats.average_rank(t("val"), "composite_score").select("building_id", F.col("rank").cast("double").alias("rank"))


@query(with_views("val") + ", p AS (SELECT row_number() OVER (ORDER BY composite_score DESC, building_id) AS position, burned FROM val) SELECT position, CAST(sum(burned) OVER (ORDER BY position) AS BIGINT) AS hits, round(sum(burned) OVER (ORDER BY position) / position, 6) AS rate FROM p")
def w5_stat8_lift_curve(t):
    d = stats.lift_curve(t("val"), "burned", "composite_score", "building_id")
    return d.select(F.col("position").cast("long").alias("position"), "hits", r6("rate", "rate"))


def _auc_sql(score: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    g, c = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    pp = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    return f"SELECT {c}count(*) AS n, CAST(sum(burned) AS BIGINT) AS n_pos, (sum(burned * r) - sum(burned) * (sum(burned) + 1) / 2.0::DOUBLE) / (sum(burned)::DOUBLE * (count(*) - sum(burned))) AS auc FROM (SELECT *, rank() OVER ({p} ORDER BY {score}) + (count(*) OVER ({pp}) - 1) / 2.0::DOUBLE AS r FROM val) {g}"


@query(with_views("val", more=f"q AS ({_auc_sql('composite_score', 'event_id')})") + " SELECT event_id, n, n_pos, round(auc, 6) AS auc FROM q")
def stat1_auc_by_event(t):
    return stats.auc(t("val"), "burned", "composite_score", ["event_id"]).select("event_id", "n", "n_pos", r6("auc", "auc"))


def _mix_sql(name: str, rows: str, keep: str) -> str:
    """``rows`` (a FROM clause with a column x) with x mixed, in steps."""
    for _ in range(2):
        rows = f"(SELECT {keep}, xor(x, x >> 16) * {resample.FACTOR} & 4294967295 AS x FROM {rows})"
    return f"{name} AS MATERIALIZED (SELECT {keep}, xor(x, x >> 16) AS x FROM {rows})"


def _bootstrap_sql(rounds: int = 1000, seed: int = 42) -> str:
    """The same hash draws, a row for each score, class and round; counts beyond those drawn by inversion don't occur."""
    edges = ", ".join(f"({m}, [{', '.join(f'({e!r})::DOUBLE' for e in resample.poisson_edges(m))}])" for m in range(1, resample.INVERTED + 1))
    keys = ", ".join(f"({r}, {c}, {int(k)})" for c in (0, 1) for r, k in enumerate(resample.round_keys(rounds, seed + c)))
    return (
        with_views("val")
        + f", edges(m, e) AS (VALUES {edges}), keys(r, c, k) AS (VALUES {keys}), f AS (SELECT event_id, composite_score AS v, CAST(sum(burned) AS BIGINT) AS p, CAST(count(*) - sum(burned) AS BIGINT) AS q, CAST(CAST(CAST(composite_score AS DOUBLE) AS BIT) AS BIGINT) AS bits FROM val GROUP BY 1, 2), "
        + _mix_sql("high", "(SELECT event_id, v, p, q, bits, bits >> 32 & 4294967295 AS x FROM f)", "event_id, v, p, q, bits")
        + ", "
        + _mix_sql("vkeys", "(SELECT event_id, v, p, q, xor(bits & 4294967295, x) AS x FROM high)", "event_id, v, p, q")
        + ", "
        + _mix_sql("h", "(SELECT event_id, v, c, r, CASE c WHEN 0 THEN p ELSE q END AS m, xor(vkeys.x, k) AS x FROM vkeys, keys)", "event_id, v, c, r, m")
        + ", w AS (SELECT event_id, v, c, r, CASE WHEN h.m = 0 THEN 0 ELSE len(list_filter(e, lambda y: y < (x + 0.5) / 4294967296)) END AS n FROM h LEFT JOIN edges ON edges.m = h.m), "
        "b AS (SELECT event_id, r, v, sum(n) FILTER (WHERE c = 0) AS p, sum(n) FILTER (WHERE c = 1) AS q FROM w GROUP BY 1, 2, 3), "
        "o AS (SELECT event_id, r, p, q, sum(q) OVER (PARTITION BY event_id, r ORDER BY v) - q / 2.0 AS below FROM b), "
        "a AS (SELECT event_id, r, sum(p * below) / sum(p) / sum(q) AS a FROM o GROUP BY 1, 2 HAVING sum(p) > 0 AND sum(q) > 0), "
        "i AS (SELECT event_id, quantile_cont(a, 0.025) AS low, quantile_cont(a, 0.975) AS high FROM a GROUP BY 1), "
        f"t AS ({_auc_sql('composite_score', 'event_id')}) SELECT t.event_id, round(t.auc, 6) AS auc, round(low, 6) AS low, round(high, 6) AS high FROM t LEFT JOIN i ON i.event_id = t.event_id"
    )


@query(_bootstrap_sql())
def stat2_bootstrap_interval(t):
    d = stats.bootstrap_auc(t("val"), "burned", "composite_score", "event_id", rounds=1000)
    return d.select("event_id", r6("auc", "auc"), r6("low", "low"), r6("high", "high"))


@query(with_views("val", more="val2 AS (SELECT *, 1.0::DOUBLE / (dist + 1) AS baseline_score FROM val)") + ", m AS (SELECT * FROM (" + _auc_sql("composite_score") + ")), b AS (SELECT * FROM (" + _auc_sql("baseline_score").replace("FROM val)", "FROM val2)") + ")), k AS (SELECT avg(burned) AS p FROM (SELECT burned FROM val ORDER BY composite_score DESC, building_id LIMIT CAST((SELECT ceil(count(*) * 0.1) FROM val) AS BIGINT))), kb AS (SELECT avg(burned) AS p FROM (SELECT burned FROM val ORDER BY dist, building_id LIMIT CAST((SELECT ceil(count(*) * 0.1) FROM val) AS BIGINT))), t AS (SELECT count(*) AS n, CAST(sum(burned) AS BIGINT) AS n_burned, avg(burned) AS prevalence, count(*) FILTER (WHERE risk_class = 5) AS n_cls5, avg(burned) FILTER (WHERE risk_class = 5) AS precision_cls5, sum(burned) FILTER (WHERE risk_class >= 4) / greatest(sum(burned), 1) AS recall_cls45 FROM val) SELECT t.n, t.n_burned, round(prevalence, 6) AS prevalence, n_cls5, round(precision_cls5, 6) AS precision_cls5, round(recall_cls45, 6) AS recall_cls45, round(m.auc, 6) AS auc_model, round(b.auc, 6) AS auc_baseline, round(m.auc - b.auc, 6) AS auc_delta, round(k.p / prevalence, 6) AS lift_model, round(kb.p / prevalence, 6) AS lift_baseline FROM t, m, b, k, kb")
def stat3_ag21_metrics(t):
    d = validation.metrics(t("val").withColumn("baseline_score", 1.0 / (F.col("dist") + 1)))
    return d.select("n", "n_burned", r6("prevalence", "prevalence"), "n_cls5", *[r6(c, c) for c in ("precision_cls5", "recall_cls45", "auc_model", "auc_baseline", "auc_delta", "lift_model", "lift_baseline")])


@query(with_views("val") + " SELECT burned, round(avg(composite_score), 6) AS composite_score, round(avg(dist), 6) AS dist FROM val GROUP BY 1")
def ag19_mean_scores(t):
    d = validation.mean_scores(t("val"), ["composite_score", "dist"])
    return d.select("burned", r6("composite_score", "composite_score"), r6("dist", "dist"))


@query(with_views("val") + " SELECT CAST(c.range AS INTEGER) AS risk_class, count(building_id) AS n, CAST(coalesce(sum(burned), 0) AS BIGINT) AS n_burned, round(coalesce(avg(burned), 0), 6) AS burned_rate FROM range(1, 6) c LEFT JOIN (SELECT * FROM val WHERE risk_class <> 3) ON risk_class = c.range GROUP BY 1")
def ag20_class_stats(t):
    d = validation.class_stats(t("val").where("risk_class <> 3"))
    return d.select("risk_class", "n", "n_burned", r6("burned_rate", "burned_rate"))


@query(with_views("val", more="z AS (SELECT *, CASE WHEN lat < 38.05 THEN 'south' ELSE 'north' END AS zone FROM val)") + ", m AS (" + _auc_sql("composite_score", "zone").replace("FROM val)", "FROM z)") + "), b AS (" + _auc_sql("nd", "zone").replace("FROM val)", "FROM (SELECT *, -dist AS nd FROM z))") + ") SELECT zone, m.n, m.n_pos AS n_burned, round(m.auc, 6) AS auc_model, round(b.auc, 6) AS auc_baseline FROM m JOIN b USING (zone)")
def ag22_zones(t):
    d = validation.zones(t("val").withColumn("baseline_score", -F.col("dist")), "lat", 38.05)
    return d.select("zone", "n", "n_burned", r6("auc_model", "auc_model"), r6("auc_baseline", "auc_baseline"))


@query(with_views("val") + " SELECT CAST(b.range AS INTEGER) AS bin, count(v.building_id) AS n FROM range(20) b LEFT JOIN (SELECT building_id, least(floor(composite_score * 20), 19) AS k FROM val WHERE composite_score BETWEEN 0 AND 1) v ON v.k = b.range GROUP BY 1")
def ag23_histogram(t):
    return stats.histogram(t("val"), "composite_score")


@query(with_views("val") + ", s AS (SELECT composite_score AS threshold, sum(burned) AS p, sum(1 - burned) AS q FROM val GROUP BY 1) SELECT round(threshold, 6) AS threshold, round(sum(q) OVER w / sum(q) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM s WINDOW w AS (ORDER BY threshold DESC)")
def stat7_roc_curve(t):
    d = stats.roc_curve(t("val"), "burned", "composite_score")
    return d.select(r6("threshold", "threshold"), r6("fpr", "fpr"), r6("tpr", "tpr"))


_FEATURES = {"size": "size", "price": "price", "qty": "qty", "all_null": "CAST(NULL AS DOUBLE)", "flat": "1.0D", "half": "CASE WHEN id % 2 = 0 THEN size END", "sparse": "CASE WHEN id % 3 = 0 THEN size END", "most": "CASE WHEN id % 4 > 0 THEN size END"}


@query(with_views("feat", more="f AS (SELECT " + ", ".join(f"{e.replace('1.0D', '1.0::DOUBLE')} AS {n}" for n, e in _FEATURES.items()) + " FROM feat)") + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, 1 - count({n}) / count(*) AS gone, min({n}) = max({n}) AS flat FROM f" for n in _FEATURES) + ") SELECT feature, CASE WHEN gone = 1 THEN 'all-NULL' WHEN gone > 0.5 THEN 'high-NULL' ELSE 'zero-variance' END AS reason FROM c WHERE gone > 0.5 OR flat")
def stat6_eligibility(t):
    """Made-up columns beside real ones; exactly half of one is missing, which is not too much."""
    d = t("feat").selectExpr(*[f"{e} AS {n}" for n, e in _FEATURES.items()])
    return t.spark.createDataFrame(list(scoring.eligibility(d, d.columns).items()), "feature string, reason string")


def _scored(t):
    """Building features with two group scores, composite and class."""
    groups = {"score_terrain": {"size": "positive", "retail": "negative", "ndvi": "positive"}, "score_history": {"price": "positive", "qty": "negative"}}
    return scoring.group_scores(t("feat"), groups).withColumn("score_history", F.coalesce("score_history", F.lit(0.0)))


_ML1 = with_views("feat", more=", ".join([_rank_sql("feat", "size", "id", "a"), _rank_sql("feat", "retail", "id", "b", True), _rank_sql("feat", "price", "id", "c"), _rank_sql("feat", "qty", "id", "d", True)])) + ", z AS (SELECT id, (a.s + b.s) / 2 AS terrain, coalesce((c.s + d.s) / 2, 0) AS history, 0.6 * ((a.s + b.s) / 2) + 0.4 * coalesce((c.s + d.s) / 2, 0) AS s FROM feat JOIN a USING (id) JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN d USING (id)), " + _EDGES


@query(_ML1 + " SELECT id, round(terrain, 6) AS score_terrain, round(history, 6) AS score_history, round(s, 6) AS composite_score FROM z")
def ml1_group_scores(t):
    d = scoring.composite(_scored(t), {"score_terrain": 0.6, "score_history": 0.4})
    return d.select("id", *[r6(c, c) for c in ("score_terrain", "score_history", "composite_score")])


@query(_ML1 + ", k AS (SELECT id, s, CAST(1 + (s > a)::INT + (s > b)::INT + (s > c)::INT + (s > d)::INT AS INTEGER) AS risk_class FROM z, e) SELECT risk_class, round(avg(s), 4) AS mean_score FROM k GROUP BY 1")
def flagship_risk_classes(t):
    """Features to group scores, composite, quintile class and class means."""
    d = scoring.composite(_scored(t), {"score_terrain": 0.6, "score_history": 0.4})
    d = stats.quantile_class(d, "composite_score")
    return d.groupBy("risk_class").agg(F.round(F.avg("composite_score"), 4).alias("mean_score"))


_RUN = {"score_terrain": {"size": "positive", "retail": "positive"}, "score_load": {"retail": "negative", "price": "positive"}, "score_gone": {"absent": "positive"}}
_MEAN = "(coalesce({0}.s, 0) + coalesce({1}.s, 0)) / (({0}.s IS NOT NULL)::INT + ({1}.s IS NOT NULL)::INT)"


@query(
    with_views("feat", more=", ".join(_rank_sql("feat", v, "id", n, negative) for v, n, negative in (("size", "a", False), ("retail", "b", False), ("retail", "c", True), ("price", "d", False))))
    + f", g AS (SELECT id, {_MEAN.format('a', 'b')} AS score_terrain, {_MEAN.format('c', 'd')} AS score_load FROM feat LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id) LEFT JOIN d USING (id)), "
    + f"k AS (SELECT *, score_terrain * ({0.5 / 0.8!r})::DOUBLE + score_load * ({0.3 / 0.8!r})::DOUBLE AS s FROM g), {_EDGES.replace('FROM z', 'FROM k')} "
    + "SELECT id, round(score_terrain, 6) AS score_terrain, round(score_load, 6) AS score_load, round(s, 6) AS composite_score, CAST(1 + (s > a)::INT + (s > b)::INT + (s > c)::INT + (s > d)::INT AS INTEGER) AS risk_class FROM k, e"
)
def sc_scoring_run(t):
    """The whole run: eligible features, group scores, weights of what is left, classes, checks, the table written and read."""
    scores, _ = scoring.scoring_run(t("feat"), "id", _RUN, {"score_terrain": 0.5, "score_load": 0.3, "score_gone": 0.2}, scratch(t.spark, "scores"), ("composite_score", "score_terrain"), least_rows=100)
    return scores.select("id", *[r6(c, c) for c in ("score_terrain", "score_load", "composite_score")], "risk_class")


def _groups(t):
    i = F.col("building_id")
    return t("val").select("building_id", *[((i * a + i * i * b) % 1009 / 1008.0).alias(f"score_{n}") for n, a, b in (("a", 37, 3), ("b", 101, 7), ("c", 53, 11), ("d", 17, 5))])


_DRAWS = ", ".join("(" + ", ".join([str(i), *(f"'{w!r}'::DOUBLE" for w in ws)]) + ")" for i, ws in enumerate(scoring.weight_draws(WEIGHTS, 500)))
_BASE = " + ".join(f"score_{n} * '{w!r}'::DOUBLE" for n, w in zip("abcd", WEIGHTS.values(), strict=True))


@query(with_views("val", more="g AS (SELECT building_id, " + ", ".join(f"((building_id * {a} + building_id * building_id * {b}) % 1009) / 1008.0::DOUBLE AS score_{n}" for n, a, b in (("a", 37, 3), ("b", 101, 7), ("c", 53, 11), ("d", 17, 5))) + " FROM val)") + f", w(r, a, b, c, d) AS (VALUES {_DRAWS}), k AS (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS k FROM g)" + ", s AS (SELECT r, building_id, score_a * a + score_b * b + score_c * c + score_d * d AS s FROM g, w), cut AS (SELECT r, min(s) AS cut FROM (SELECT r, s, row_number() OVER (PARTITION BY r ORDER BY s DESC) AS rn FROM s), k WHERE rn <= k GROUP BY r), top AS (SELECT building_id FROM g ORDER BY " + _BASE + " DESC, building_id LIMIT (SELECT k FROM k)) SELECT building_id, round(count(*) FILTER (WHERE s >= cut - 1e-12) / 500, 6) AS stability FROM top JOIN s USING (building_id) JOIN cut USING (r) GROUP BY 1")
def stat5_weight_sensitivity(t):
    return scoring.weight_stability(_groups(t), "building_id", WEIGHTS, rounds=500).select("building_id", r6("stability", "stability"))


_X = ["x", "y", "dist", "composite_score"]


@query()
def ml2_ml3_leave_one_event_out(t):
    d = model.leave_one_out(t("val"), "event_id", _X, "burned", trees=200, depth=6)
    return d.select("event_id", "building_id", r6("probability_burned", "probability_burned"), r6("composite_score", "composite_score"))


@query()
def ml5_event_metrics(t):
    d = model.leave_one_out(t("val"), "event_id", _X, "burned", trees=200, depth=6)
    return model.event_metrics(d, "event_id", "burned", "probability_burned", "composite_score")


@query()
def ml4_ml6_importances(t):
    """Mean absolute Shapley values of the full-data model over all rows, and its gains."""
    m = model.fit(t("val"), _X, "burned", trees=200, depth=6)
    d = shapley.mean_importances(m, t("val"), _X)
    return d.select("feature", r6("mean_abs_shap", "mean_abs_shap"), r6("gain", "importance"))


@query("SELECT * FROM (VALUES ('table', 'kq_nation', true, ''), ('columns', 'kq_nation', false, 'n_area'), ('table', 'kq_missing', false, 'missing'), ('nulls', 'kq_nation.n_name', true, '0')) v(\"check\", subject, ok, detail)")
def qc1_catalog_checks(t):
    t("nation").createOrReplaceTempView("kq_nation")
    return quality.check_catalog(t.spark, {"kq_nation": ["n_name", "n_area"], "kq_missing": ["x"]}, {"kq_nation": ["n_name"]})


_CHECKED = ["composite_score", "score_a", "score_b"]


def _check_sql() -> str:
    rows = ["SELECT 'rows' AS \"check\", 'all' AS subject, count(*) >= 1000 AS ok, count(*)::DOUBLE AS value FROM q"]
    for c in _CHECKED:
        rows += [f"SELECT 'nulls', '{c}', count(*) = count({c}), (count(*) - count({c}))::DOUBLE FROM q", f"SELECT 'at least 0', '{c}', min({c}) >= 0, min({c}) FROM q", f"SELECT 'at most 1', '{c}', max({c}) <= 1, max({c}) FROM q"]
    rows += [f"SELECT 'share', 'class {k}', avg((risk_class = {k})::INT) BETWEEN 0.18 AND 0.22, avg((risk_class = {k})::INT) FROM q" for k in range(1, 6)]
    rows.append("SELECT 'correlation', 'composite_score and score_a', corr(composite_score, score_a) > 0.3, corr(composite_score, score_a) FROM q")
    return " UNION ALL ".join(rows)


@query(with_views("val", more="q AS (SELECT composite_score, risk_class, composite_score * 0.5 + (building_id % 7) / 20.0 AS score_a, CASE WHEN building_id % 11 > 0 THEN (building_id % 13) / 12.0 - 0.1 END AS score_b FROM val), u AS (" + _check_sql() + ")") + ' SELECT "check", subject, ok, round(value, 6) AS value FROM u')
def qc2_score_checks(t):
    b = F.col("building_id")
    d = t("val").select("composite_score", "risk_class", (F.col("composite_score") * 0.5 + b % 7 / 20.0).alias("score_a"), F.when(b % 11 > 0, b % 13 / 12.0 - 0.1).alias("score_b"))
    return quality.score_checks(d, _CHECKED, "risk_class", ("composite_score", "score_a"), least_rows=1000).select("check", "subject", "ok", r6("value", "value"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 1")
def qc2_assertions(t):
    return quality.asserted(t("part"), F.col("p_size") >= 1, "sizes start at 1").select("p_partkey", "p_size")


@query(with_views("val") + " SELECT risk_class, round(lat, 4) AS lat, round(x, 4) AS lon FROM val")
def snk9_map_payload(t):
    """The payload's points, read back from its text."""
    from ..sources.readers import map_payload

    points = map_payload(t("val"), "lat", "x").select("risk_class", F.explode(F.from_json("payload", "array<array<double>>")).alias("p"))
    return points.select("risk_class", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))
