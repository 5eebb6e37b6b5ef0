"""Round trips: tables written by a sink and read back by its source, held against the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import scratch, spread
from ..sources import files, parts, readers
from .core import r6
from .spatial import _FOOTPRINT
from .tables import PIX, registry, with_views

Q, SQL, query = registry()


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders")
def src3_snk4_csv(t):
    """A report with four decimals and a header, read back by its schema."""
    path = scratch(t.spark, "csv")
    readers.write_csv(t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path, 4)
    return readers.scan_csv(t.spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")


@query("SELECT o_orderpriority AS name, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def src4_snk7_json_metrics(t):
    path = scratch(t.spark, "json")
    readers.write_metrics(t("orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), r6(F.avg("o_totalprice"), "mean")), path)
    return readers.scan_json(t.spark, path, "name string, n long, mean double", lines=True)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS value FROM lineitem WHERE l_quantity > 10")
def src17_snk5_cached_parquet(t):
    """Made once, then read: the second call must not make it again."""
    path, made = scratch(t.spark, "cache"), []

    def make():
        made.append(1)
        return t("lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 4).alias("value"))

    readers.cached(t.spark, path, make)
    out = readers.cached(t.spark, path, make)
    if len(made) != 1:
        raise ValueError("the cache was not used")
    return out


@query("SELECT s_name, s_suppkey, round(s_acctbal, 4) AS s_acctbal FROM supplier WHERE s_suppkey % 3 > 0")
def snk1_snk3_replaced_table(t):
    """A table replaced by other rows, its columns in the order asked for."""
    d = t("supplier").select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"), "s_name", "s_nationkey")
    name = "kq_" + scratch(t.spark, "t").rsplit("-", 1)[1]
    readers.load_ordered(d, name, ["s_name", "s_suppkey"])
    return readers.load_ordered(d.where("s_suppkey % 3 > 0"), name, ["s_name", "s_suppkey", "s_acctbal"])


@query(with_views("val") + " SELECT event_id, building_id, round(composite_score + CASE WHEN event_id IN (1, 3) THEN 1 ELSE 0 END, 6) AS score FROM val WHERE event_id NOT IN (1, 3) OR building_id % 3 = 0")
def snk2_upserted_events(t):
    """Two of four events replaced by fewer rows; the others stay."""
    d, path = t("val").select("event_id", "building_id", r6("composite_score", "score")), scratch(t.spark, "events")
    readers.upsert_events(d, path)
    return readers.upsert_events(d.where("event_id in (1, 3) and building_id % 3 = 0").withColumn("score", F.round(F.col("score") + 1, 6)), path)


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS event_id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def src16_events_with_files(t):
    """A metrics file for each customer with orders, a score file for some: those that have both are found."""
    path = scratch(t.spark, "found")
    named = lambda d, end: d.select("o_custkey").distinct().select(F.concat(F.col("o_custkey").cast("string"), F.lit(end)).alias("name"), F.encode(F.lit("{}"), "utf-8").alias("content"))
    o = t("orders")
    parts.write_files(spread(named(o, "_metrics.json").unionByName(named(o.where("o_orderkey % 3 = 0"), "_scores.csv"))), path)
    return parts.with_companion(t.spark, path).select(F.col("stem").alias("event_id"))


@query(f"WITH f AS ({_FOOTPRINT}) SELECT id, 'use ' || CAST(kind AS VARCHAR) AS use, round(a * b, 6) AS area FROM f")
def src2_snk6_geopackage(t):
    """Footprints as GeoPackage files of executors' rows, read back with their rings."""
    at = lambda x, y: F.struct((F.col("u") + x).alias("x"), (F.col("w") + y).alias("y"))
    a, b, o = F.col("a"), F.col("b"), F.lit(0.0)
    d = t.sql(_FOOTPRINT).select("id", F.concat(F.lit("use "), F.col("kind").cast("string")).alias("use"), F.array(at(o, o), at(a, o), at(a, b), at(o, b), at(o, o)).alias("ring"))
    path = scratch(t.spark, "gpkg")
    parts.write_geopackages(d, path, "buildings")
    return files.read_geopackage(t.spark, f"{path}/*.gpkg", "buildings", "id long, use string").select("id", "use", r6(G.ring_area(F.col("ring")), "area"))


@query("WITH " + PIX + " SELECT row, col, v, CAST(1000 + (col + 0.5) * 30 AS DOUBLE) AS x, CAST(9000 - (row + 0.5) * 20 AS DOUBLE) AS y FROM pix")
def src5_snk6_geotiff(t):
    """The raster as GeoTIFF tiles, read back with the places of their pixels."""
    path = scratch(t.spark, "tif")
    parts.write_geotiff_tiles(t.pixels(), path, 1000.0, 9000.0, 30.0, 20.0, tile=64)
    d = files.read_geotiff(t.spark, f"{path}/*.tif").where("v is not null")
    return d.select(F.floor((9000.0 - F.col("y")) / 20.0).alias("row"), F.floor((F.col("x") - 1000.0) / 30.0).alias("col"), "v", "x", "y")


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CAST(37 + o_custkey % 7 * 0.5 AS DOUBLE) AS latitude, CAST(20 + o_custkey % 5 * 0.5 AS DOUBLE) AS longitude, round(max(o_totalprice), 4) AS price FROM orders GROUP BY 1, 2, 3")
def src6_snk6_netcdf(t):
    """A daily grid as NetCDF files by month, read back in long form."""
    d = t("orders").groupBy(F.to_date("o_orderdate").cast("timestamp").alias("ts"), (37.0 + F.col("o_custkey") % 7 * 0.5).alias("latitude"), (20.0 + F.col("o_custkey") % 5 * 0.5).alias("longitude")).agg(F.round(F.max("o_totalprice"), 4).alias("price"))
    path = scratch(t.spark, "nc")
    parts.write_netcdf_years(d, path, ["price"])
    return files.read_netcdf(t.spark, f"{path}/*.nc", ["price"]).where("price is not null")


@query("WITH c AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1) SELECT '| ' || p || ' | ' || CAST(n AS VARCHAR) || ' | ' || printf('%.4f', m) || ' |' AS line FROM c UNION ALL SELECT '# Orders' UNION ALL SELECT '## Priorities' UNION ALL SELECT '| priority | n | mean |'")
def snk8_report(t):
    """Lines of a Markdown report, rules and blank lines left out."""
    d = t("orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    lines = [x for x in readers.report("Orders", [("Priorities", d)]).split("\n") if x and not x.startswith("|---")]
    return t.spark.createDataFrame([(x,) for x in lines], "line string")
