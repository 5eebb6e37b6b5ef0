"""Scans, filters, joins, aggregates, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import scoring, spatial, stats
from .tables import registry, with_views

Q, SQL, query = registry()


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def src1_scan_projection(t):
    return t("supplier").select("s_suppkey", "s_name", r6("s_acctbal", "s_acctbal"))


@query("SELECT s.range AS bin, count(e.event_id) AS n FROM range(5) s LEFT JOIN events e ON e.event_id % 5 = s.range GROUP BY 1")
def src7_union_of_chunks(t):
    parts = [t("events").where(F.col("event_id") % 5 == k).select("event_id") for k in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy((F.col("event_id") % 5).alias("bin")).agg(F.count("event_id").alias("n"))


@query("SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, CAST(day(last_day(m)) AS INTEGER) AS days FROM (SELECT unnest(generate_series(date_trunc('month', min(CAST(o_orderdate AS DATE))), max(CAST(o_orderdate AS DATE)), INTERVAL 1 MONTH)) AS m FROM orders)")
def src13_month_requests(t):
    from ..sources.requests import month_requests

    first, last = t("orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return month_requests(t.spark, str(first), str(last))


@query("SELECT o_orderkey, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, count(*) AS n_days FROM (SELECT o_orderkey, unnest([CAST(o_orderdate AS DATE) - 1, CAST(o_orderdate AS DATE)]) AS d FROM orders) GROUP BY ALL")
def src13_event_requests(t):
    from ..sources.requests import event_requests

    d = event_requests(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("event_date")))
    return d.select("o_orderkey", "year", "month", F.size("days").cast("long").alias("n_days"))


@query("SELECT o_custkey, CAST(s AS DATE) AS batch_start, CAST(least(date_diff('day', CAST(s AS DATE), b) + 1, 30) AS INTEGER) AS day_count FROM (SELECT o_custkey, b, unnest(generate_series(a, b, INTERVAL 30 DAY)) AS s FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1))")
def src14_date_batches(t):
    from ..sources.requests import batches_of

    d = t("orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last"))
    return batches_of(d, most=30).select("o_custkey", "batch_start", "day_count")


@query("WITH b AS (SELECT -170 + s_suppkey*7 % 330 AS west, s_suppkey % 5 AS wide, -60 + s_suppkey*11 % 120 AS south, s_suppkey % 4 AS high FROM supplier), t AS (SELECT la, unnest(range(CAST(floor(west / 3.0) AS BIGINT) * 3, CAST(floor((west + wide) / 3.0) AS BIGINT) * 3 + 1, 3)) AS lo FROM (SELECT *, unnest(range(CAST(floor(south / 3.0) AS BIGINT) * 3, CAST(floor((south + high + 0.5) / 3.0) AS BIGINT) * 3 + 1, 3)) AS la FROM b)) SELECT CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(la) AS VARCHAR), 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lo) AS VARCHAR), 3, '0') AS tile_id, count(*) AS n_boxes FROM t GROUP BY 1")
def src15_tiles(t):
    from ..sources.requests import tiles_of

    boxes = t.sql("SELECT -170 + s_suppkey*7 % 330 AS west, -60 + s_suppkey*11 % 120 AS south, s_suppkey % 5 AS wide, s_suppkey % 4 AS high FROM supplier").selectExpr("west", "south", "west + wide AS east", "south + high + 0.5D AS north")
    return tiles_of(boxes).groupBy("tile_id").agg(F.count("*").alias("n_boxes"))


@query("SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL AND k > 50")
def pf1_pf2_json_notnull(t):
    d = t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return d.dropna(how="any").where("k > 50")


@query(with_views("bld") + " SELECT id, x, y FROM bld WHERE x BETWEEN 20000 AND 40000 AND y BETWEEN 10000 AND 30000")
def pf3_bbox_between(t):
    return t("bld").where(F.col("x").between(20000, 40000) & F.col("y").between(10000, 30000))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def pf4_parameter_predicate(t):
    return t.spark.sql("SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey = :k", args={"k": 7}, nation=t("nation"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def pf5_pf6_in_and_semi_join(t):
    rich = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").where(F.col("o_orderstatus").isin("F", "P")).join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query(with_views("val") + " SELECT building_id FROM val WHERE burned = 1")
def pf7_boolean(t):
    return t("val").withColumn("hit", F.col("burned") == 1).where("hit").select("building_id")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS area FROM part WHERE p_size >= 5 AND p_name IS NOT NULL AND p_name <> ''")
def pf8_pf9_minimum_area(t):
    return t("part").where(F.col("p_size") >= 5.0).where("p_name is not null and p_name <> ''").select("p_partkey", F.col("p_size").cast("double").alias("area"))


@query(with_views("fires") + " SELECT fid FROM fires WHERE fx - r <= 42000 AND fx + r >= 18000 AND fy - r <= 52000 AND fy + r >= 8000")
def pf10_envelope_overlap(t):
    return t("fires").where("fx - r <= 42000 and fx + r >= 18000 and fy - r <= 52000 and fy + r >= 8000").select("fid")


@query("SELECT o_orderkey FROM orders WHERE month(o_orderdate) BETWEEN 6 AND 10")
def pf11_season_months(t):
    from ..operators.timeseries import in_season

    return in_season(t("orders"), "o_orderdate").select("o_orderkey")


@query("SELECT count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 23:00:00') AS h24, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 23:00:00') AS h12, count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-14') AS before FROM events")
def pf12_pf13_time_windows(t):
    end = F.lit("2024-01-15 23:00:00").cast("timestamp")
    return t("events").agg(
        F.count_if(F.col("ts").between(end - F.expr("INTERVAL 23 HOURS"), end)).alias("h24"),
        F.count_if(F.col("ts").between(end - F.expr("INTERVAL 11 HOURS"), end)).alias("h12"),
        F.count_if(F.to_date("ts").between(F.date_sub(F.to_date(F.lit("2024-01-15")), 10), F.date_sub(F.to_date(F.lit("2024-01-15")), 1))).alias("before"),
    )


@query("SELECT o_orderkey AS osm_id, CASE WHEN o_orderkey % 3 = 0 THEN 'school' ELSE 'yes' END AS building, CASE WHEN o_orderkey % 3 = 0 THEN 'civic' ELSE 'unknown' END AS building_use, CAST(4 AS INTEGER) AS points FROM orders WHERE o_orderkey % 2 = 0")
def pf14_sc21_sc22_elements(t):
    """Ways of an Overpass-like answer; nodes and degenerate ways go."""
    from ..sources.requests import overpass_buildings

    point = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))
    even = F.col("o_orderkey") % 2 == 0
    ring = F.when(even, F.array(point(0.0, 0.0), point(0.0, 1.0), point(1.0, 1.0))).otherwise(F.array(point(0.0, 0.0), point(0.0, 1.0)))
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("building"), F.lit("school"))).otherwise(F.create_map(F.lit("height"), F.lit("3")))
    el = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), ring.alias("geometry"), tags.alias("tags"))
    node = F.struct(F.lit("node").alias("type"), F.col("o_orderkey").alias("id"), ring.alias("geometry"), tags.alias("tags"))
    d = overpass_buildings(t("orders").select(F.to_json(F.struct(F.array(el, node).alias("elements"))).alias("body")))
    return d.select("osm_id", "building", "building_use", F.size("ring").alias("points"))


@query(with_views("bld") + " SELECT 'mati_2018' AS event_id, id AS building_id, round(x / 1000.0, 4) AS lat4, round(y / 1000.0, 5) AS lon5 FROM bld")
def pf15_pf16_literal_and_round(t):
    return t("bld").select(F.lit("mati_2018").alias("event_id"), F.col("id").alias("building_id"), F.round(F.col("x") / 1000.0, 4).alias("lat4"), F.round(F.col("y") / 1000.0, 5).alias("lon5"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS height FROM nation")
def pf17_pf18_missing_and_cast(t):
    from ..sources.readers import with_columns

    return with_columns(t("nation").select("n_nationkey", "n_name"), {"n_nationkey": "bigint", "n_name": "string", "height": "string"})


@query("SELECT p_partkey, 'B' || lpad(CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS VARCHAR), 7, '0') AS building_id FROM part")
def pf19_dense_ids(t):
    d = stats.ordered_position(t("part").select("p_partkey", "p_size"), "p_size", "p_partkey")
    return d.select("p_partkey", F.format_string("B%07d", F.col("position") - 1).alias("building_id"))


_J1 = "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, l_orderkey, l_linenumber, s_name, o_orderstatus FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45"


@query(_J1)
def j1_four_way_join(t):
    li = t("lineitem").where("l_quantity > 45").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    d = li.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select("p_partkey", r6("p_retailprice", "p_retailprice"), "l_orderkey", "l_linenumber", "s_name", "o_orderstatus")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def j2_six_table_join(t):
    d = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).where("o_orderstatus <> 'P'")
    d = d.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = d.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    d = d.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(with_views("bld", "val") + " SELECT id, round(b.x, 4) AS x, round(composite_score, 6) AS s FROM bld b JOIN val ON id = building_id")
def j3_two_way_join(t):
    return t("bld").join(t("val").select("building_id", "composite_score"), F.col("id") == F.col("building_id")).select("id", F.round("x", 4).alias("x"), r6("composite_score", "s"))


@query(with_views("bld", "val") + " SELECT count(*) AS n, round(avg(composite_score), 6) AS mean_score, round(max(composite_score), 6) AS max_score FROM bld b JOIN val ON id = building_id WHERE b.x BETWEEN 30000 AND 50000")
def j4_join_filter_aggregate(t):
    d = t("bld").where(F.col("x").between(30000, 50000)).select("id").join(t("val").select("building_id", "composite_score"), F.col("id") == F.col("building_id"))
    return d.agg(F.count("*").alias("n"), r6(F.avg("composite_score"), "mean_score"), r6(F.max("composite_score"), "max_score"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(max(o_totalprice), 6) AS largest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j5_left_join(t):
    d = t("customer").select("c_custkey").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return d.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), r6(F.max("o_totalprice"), "largest"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS unmatched FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j6_join_row_counts(t):
    return t("lineitem").select("l_orderkey").join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("unmatched"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j7_different_key_names(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).drop("s_nationkey", "n_nationkey").select("s_suppkey", "n_name")


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_tax), 4) AS total FROM lineitem")
def ag1_ag2_global(t):
    return t("lineitem").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.sum("l_tax"), 4).alias("total"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS open_qty FROM lineitem GROUP BY 1")
def ag3_filtered(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), r6(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), "open_qty"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ag4_count_distinct(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def ag5_group_count(t):
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT cell, n, round(n * 100.0 / (SELECT count(*) FROM events), 6) AS pct FROM (SELECT user_id % 72 AS cell, count(*) AS n FROM events GROUP BY 1)")
def ag6_share_of_total(t):
    g = t("events").groupBy((F.col("user_id") % 72).alias("cell")).agg(F.count("*").alias("n"))
    return g.select("cell", "n", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), "pct"))


@query("SELECT count(*) AS cells, round(avg(n), 6) AS mean, round(median(n), 6) AS med, round(stddev_samp(n), 6) AS sd, min(n) AS lo, max(n) AS hi FROM (SELECT user_id % 72 AS cell, count(*) AS n FROM events GROUP BY 1)")
def ag7_distribution_summary(t):
    g = t("events").groupBy((F.col("user_id") % 72).alias("cell")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("cells"), r6(F.avg("n"), "mean"), r6(F.median("n"), "med"), r6(F.stddev_samp("n"), "sd"), F.min("n").alias("lo"), F.max("n").alias("hi"))


@query(with_views("feat") + " SELECT id, round((coalesce(price, 0) + coalesce(disc, 0) + size) / ((price IS NOT NULL)::INT + (disc IS NOT NULL)::INT + 1), 6) AS m FROM feat")
def ag15_row_mean(t):
    return t("feat").select("id", r6(S.row_mean("price", "disc", "size"), "m"))


@query(with_views("feat") + " SELECT id, round(size * 0.25 + retail * 0.75, 6) AS composite_score FROM feat")
def ag16_weighted_sum(t):
    return scoring.composite(t("feat"), {"size": 0.25, "retail": 0.75}).select("id", r6("composite_score", "composite_score"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def ag17_correlation(t):
    return t("lineitem").agg(r6(F.corr("l_quantity", "l_extendedprice"), "r"))


@query(with_views("feat") + " SELECT round(avg((price IS NULL)::INT), 6) AS price_null, round(avg((size IS NULL)::INT), 6) AS size_null FROM feat")
def ag18_null_fraction(t):
    return t("feat").agg(*[r6(F.avg(F.col(c).isNull().cast("int")), f"{c}_null") for c in ("price", "size")])


@query(with_views("val") + " SELECT min(event_id) AS e, round(avg(composite_score) FILTER (WHERE event_id IN (0, 1, 2)), 6) AS mean3, CAST(max_by(event_id, s) AS INTEGER) AS top, CAST(min_by(event_id, s) AS INTEGER) AS low FROM (SELECT event_id, avg(composite_score) AS composite_score, avg(composite_score) AS s FROM val GROUP BY 1)")
def ag24_ag25_across_events(t):
    g = t("val").groupBy("event_id").agg(F.avg("composite_score").alias("s"))
    return g.agg(F.min("event_id").alias("e"), r6(F.avg(F.when(F.col("event_id").isin(0, 1, 2), F.col("s"))), "mean3"), F.max_by("event_id", "s").alias("top"), F.min_by("event_id", "s").alias("low"))


@query(with_views("bld") + ", g AS (SELECT b.id, CAST(p_size AS DOUBLE) AS area, CAST(round_even(x / 2500.0, 0) AS BIGINT) AS gx, CAST(round_even(y / 2500.0, 0) AS BIGINT) AS gy FROM bld b JOIN part ON p_partkey = id) SELECT id, area FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY area DESC, id) AS rn FROM g) WHERE rn = 1")
def ag26_sc11_dedup_by_cell(t):
    d = t("bld").join(t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("area")), "id")
    return spatial.dedup_by_cell(d, "x", "y", 2500.0, "area", "id").select("id", "area")


@query("WITH s AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1), r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_orderkey * 7919 + l_linenumber * 104729) % 1000003, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_returnflag, l_orderkey, l_linenumber FROM r JOIN s USING (l_returnflag) WHERE r <= least(n, greatest(1, CAST(round(300.0 * n / t, 0) AS BIGINT)))")
def ag27_stratified_sample(t):
    """Rows of each stratum in proportion, those with the least draws."""
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("u", (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000003)
    return stats.stratified_sample(d, "l_returnflag", 300, ["u", "l_orderkey", "l_linenumber"]).select("l_returnflag", "l_orderkey", "l_linenumber")


@query(with_views("val") + " SELECT building_id FROM val WHERE burned = 1 AND risk_class <= 2 ORDER BY composite_score, building_id LIMIT 20")
def t2_top_ascending(t):
    from ..operators.validation import failures

    return failures(t("val"), "building_id")[0].select("building_id")


@query(with_views("val") + " SELECT building_id FROM val WHERE burned = 0 AND risk_class >= 4 ORDER BY composite_score DESC, building_id LIMIT 20")
def t3_top_descending(t):
    from ..operators.validation import failures

    return failures(t("val"), "building_id")[1].select("building_id")


@query(with_views("val") + " SELECT building_id, row_number() OVER (ORDER BY composite_score DESC, building_id) AS position FROM val QUALIFY position <= (SELECT greatest(1, ceil(count(*) * 0.1)) FROM val)")
def t4_top_fraction(t):
    return stats.top_fraction(t("val"), "composite_score", "building_id", 0.10).select("building_id", F.col("position").cast("long").alias("position"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10")
def t1_t5_t6_sorted_head(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(10)


@query(with_views("val") + " SELECT event_id, count(*) AS n FROM val WHERE event_id <> 2 GROUP BY 1")
def u1_union_all(t):
    v = t("val").select("event_id", "building_id")
    parts = [v.where(F.col("event_id") == e) for e in (0, 1, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def u3_set_difference(t):
    own = t("orders").where(F.col("o_orderkey") % 3 == 0).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(own, "c_custkey", "left_anti")


@query(with_views("val") + ", a AS (SELECT building_id FROM val ORDER BY composite_score DESC, building_id LIMIT CAST((SELECT ceil(count(*) * 0.1) FROM val) AS BIGINT)), b AS (SELECT building_id FROM val ORDER BY dist DESC, building_id LIMIT CAST((SELECT ceil(count(*) * 0.1) FROM val) AS BIGINT)) SELECT count(*) AS shared FROM a JOIN b USING (building_id)")
def u4_top_intersection(t):
    v = t("val")
    a, b = (stats.top_fraction(v, s, "building_id", 0.10).select("building_id") for s in ("composite_score", "dist"))
    return a.join(b, "building_id").agg(F.count("*").alias("shared"))


_WX = with_views("wx")


@query(_WX + " SELECT cell, ts, fwi, round(greatest(6.112*exp(17.67*(t2m-273.15)/(t2m-273.15+243.5)) - 6.112*exp(17.67*(d2m-273.15)/(d2m-273.15+243.5)), 0), 6) AS vpd, round(least(greatest(100.0*exp(17.67*(d2m-273.15)/(d2m-273.15+243.5))/exp(17.67*(t2m-273.15)/(t2m-273.15+243.5)), 0), 100), 6) AS rh, round(sqrt(u10*u10+v10*v10)*3.6, 6) AS kmh, round(atan2(v10, u10), 6) AS dir FROM wx")
def sc1_sc2_sc3_weather(t):
    return t("wx").select("cell", "ts", "fwi", r6(S.vpd_hpa("t2m", "d2m"), "vpd"), r6(S.relative_humidity("t2m", "d2m"), "rh"), r6(S.wind_speed("u10", "v10") * 3.6, "kmh"), r6(S.wind_direction("u10", "v10"), "dir"))


@query("SELECT p_partkey, round((1 - cos(radians(p_partkey % 360))) / 2, 6) AS south, CASE WHEN p_size / 50.0 >= 0.5 AND p_partkey % 100 >= 50 THEN 1 WHEN p_size / 50.0 >= 0.5 THEN 2 ELSE 0 END AS wui, CASE WHEN p_size IN (10, 20, 30) THEN 1 WHEN p_size = 1 THEN 255 ELSE 0 END AS cls, CAST(greatest(least(p_size, 45), 5) AS INTEGER) AS wins FROM part")
def sc4_sc5_sc6_sc17(t):
    p = F.col("p_partkey")
    return t("part").select("p_partkey", r6(S.south_exposure((p % 360).cast("double")), "south"), S.wui_class(F.col("p_size") / 50.0, p % 100, 0.5, 50).alias("wui"), S.reclassify("p_size", [10, 20, 30], nodata=1).alias("cls"), S.winsorise("p_size", 5, 45).alias("wins"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'civic' WHEN 2 THEN 'industrial' WHEN 3 THEN 'unknown' ELSE 'civic' END AS use FROM orders")
def sc7_building_use(t):
    k = F.col("o_orderkey") % 5
    tag = F.element_at(F.array(*[F.lit(x) for x in ("HOUSE", "church", "Warehouse", "shed", "yes")]), (k + 1).cast("int"))
    return t("orders").select("o_orderkey", S.building_use(tag, F.when(k == 4, "clinic").otherwise("")).alias("use"))


@query("SELECT n_nationkey, replace(printf('LAT%.1f_LON%.1f', 37.0 + n_nationkey / 10.0, 23.0 + n_nationkey / 5.0), '.', 'p') AS cell, 'EFFIS_201807' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS eid, round(sqrt(n_nationkey * 1e6 / pi()), 6) AS radius, CAST(round_even(n_nationkey / 2.0, 0) AS BIGINT) AS snap FROM nation")
def sc8_sc9_sc10_sc11(t):
    k = F.col("n_nationkey")
    return t("nation").select("n_nationkey", S.cell_id(37.0 + k / 10.0, 23.0 + k / 5.0).alias("cell"), S.event_id(F.concat(F.lit("2018-07-"), F.lpad((k + 1).cast("string"), 2, "0")), k).alias("eid"), r6(S.circle_radius_m(k), "radius"), S.grid_snap(k, 2.0).alias("snap"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(o_orderdate AS DATE) - 30 AS before, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, 'https://b' || o_orderkey % 3 || '.s3.eu-central-1.amazonaws.com/k/' || o_orderkey AS url, CASE WHEN o_totalprice / 500000 >= 0.7 THEN 'PASS' WHEN o_totalprice / 500000 >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS grade FROM orders")
def sc12_sc13_sc14_sc15(t):
    url = F.concat(F.lit("s3://b"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/k/"), F.col("o_orderkey").cast("string"))
    return t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_sub("o_orderdate", 30).alias("before"), F.trunc("o_orderdate", "month").alias("month_start"), S.https_of_s3(url, "eu-central-1").alias("url"), S.grade(F.col("o_totalprice") / 500000).alias("grade"))


@query(with_views("val") + " SELECT building_id, burned = 1 AND risk_class <= 2 AS fn, NOT (burned = 1) AND risk_class >= 4 AS fp, printf('%.3f', composite_score) AS shown FROM val")
def sc16_sc20_flags_and_format(t):
    b = F.col("burned") == 1
    return t("val").select("building_id", S.false_negative(b, "risk_class").alias("fn"), S.false_positive(b, "risk_class").alias("fp"), F.format_string("%.3f", "composite_score").alias("shown"))


@query(with_views("feat") + " SELECT id, CASE WHEN price IS NULL THEN NULL ELSE round(price, 6) END AS price FROM feat")
def sc19_null_of_nan(t):
    nan = F.coalesce("price", F.lit(float("nan")))
    return t("feat").select("id", r6(S.null_of_nan(nan), "price"))


_GROUPS = {"size": 0.25, "retail": 0.25, "price": 0.15, "qty": 0.10, "disc": 0.25}


@query(with_views("feat") + ", w AS (SELECT *, " + " + ".join(f"CASE WHEN {g} IS NULL THEN 0 ELSE {w}::DOUBLE END" for g, w in _GROUPS.items()) + " AS total FROM feat) SELECT id, " + ", ".join(f"round(CASE WHEN {g} IS NOT NULL THEN {w}::DOUBLE / total END, 6) AS w_{g}" for g, w in _GROUPS.items()) + " FROM w")
def sc18_redistributed_weights(t):
    """The weights of the groups that a row has values for."""
    return t("feat").select("id", *[r6(w, f"w_{g}") for g, w in S.redistributed_weights(_GROUPS).items()])
