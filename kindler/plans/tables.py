"""Driver tables and the geometry derived from them by whole-number arithmetic, as SQL that both engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

NAMES = "region nation customer supplier part orders lineitem events".split()

#: Derived inputs: buildings, weather cells, perimeters (circles, and places of polygons), hotspots, building features, a backtest frame, pixels, weather.
VIEWS = {
    "bld": "SELECT p_partkey AS id, CAST((p_partkey*7919 + p_partkey*p_partkey*31) % 80000 AS DOUBLE) AS x, CAST((p_partkey*10473 + p_partkey*p_partkey*17) % 78000 AS DOUBLE) AS y FROM part",
    "cells": "SELECT s_suppkey AS cid, CAST(s_suppkey*7717 % 80000 AS DOUBLE) AS cx, CAST(s_suppkey*5351 % 78000 AS DOUBLE) AS cy, s_acctbal AS v FROM supplier",
    "fires": "SELECT n_nationkey AS fid, 2000+n_nationkey AS yr, CAST(n_nationkey*31337 % 80000 AS DOUBLE) AS fx, CAST(n_nationkey*21001 % 78000 AS DOUBLE) AS fy, CAST(500+150*n_nationkey AS DOUBLE) AS r FROM nation",
    "per": "SELECT s_suppkey AS pid, CAST(2000 + s_suppkey % 25 AS INT) AS yr, CAST(s_suppkey*7717 % 80000 AS DOUBLE) AS cx, CAST(s_suppkey*5351 % 78000 AS DOUBLE) AS cy, CAST(100 + s_suppkey*37 % 50 * 40 AS DOUBLE) AS r FROM supplier",
    "hot": "SELECT o_orderkey AS hid, CAST((o_orderkey*7919 + o_orderkey*o_orderkey*31) % 80000 AS DOUBLE) AS hx, CAST((o_orderkey*10473 + o_orderkey*o_orderkey*17) % 78000 AS DOUBLE) AS hy FROM orders",
    "feat": "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, f.price, f.qty, f.disc FROM part LEFT JOIN (SELECT l_partkey, avg(l_extendedprice) AS price, sum(l_quantity) AS qty, max(l_discount) AS disc FROM lineitem WHERE l_quantity > 10 GROUP BY l_partkey) f ON p_partkey = f.l_partkey",
    "val": "SELECT id AS building_id, x, y, y / 1000.0 AS lat, CASE WHEN (x-40000)*(x-40000)+(y-39000)*(y-39000) < 225000000.0 THEN 1 ELSE 0 END AS burned, CAST((id*37 + (id*id) % 101) % 1000 AS DOUBLE) / 1000.0 + CASE WHEN (x-40000)*(x-40000)+(y-39000)*(y-39000) < 225000000.0 THEN 0.25 ELSE 0.0 END AS composite_score, CAST((id*7 + (id*id*id) % 13) % 97 AS DOUBLE) AS dist, CAST(1 + id % 5 AS INT) AS risk_class, CAST(id % 4 AS INT) AS event_id FROM (SELECT p_partkey AS id, CAST((p_partkey*7919 + p_partkey*p_partkey*31) % 80000 AS DOUBLE) AS x, CAST((p_partkey*10473 + p_partkey*p_partkey*17) % 78000 AS DOUBLE) AS y FROM part) b",
    "wx": "SELECT CAST(user_id % 72 AS BIGINT) AS cell, ts, value AS fwi, value * 2 AS dc, value / 40.0 - 6.0 AS u10, CAST(event_id % 17 AS DOUBLE) - 8.0 AS v10, 290.0 + value / 40.0 AS t2m, 280.0 + CAST(event_id % 11 AS DOUBLE) AS d2m FROM events",
}

#: Of the views, what leaves a long for many rows, and its equal that does not (from 2,097,152 on, id*id*id does).
EQUALS = {"(id*id*id) % 13": "((id % 13)*(id % 13)*(id % 13)) % 13"}


class Tables:
    """Tables and views of one data folder, resolved when a query is built."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            for given, equal in EQUALS.items():
                text = text.replace(given, equal)
            return self.sql(text)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """SQL over the driver tables, given as named DataFrames."""
        used = [n for n in NAMES if n in text]
        for n in used:
            text = _replaced(text, n)
        return self.spark.sql(text, **{n: self(n) for n in used})

    def pixels(self) -> DataFrame:
        """A raster with a line of 50 pixels for each part (row, col, v), one pixel in eleven missing."""
        lines = spread(self.sql("SELECT p_partkey AS row, CAST(p_size AS BIGINT) AS z FROM part"))
        cells = lines.selectExpr("row", "z", "explode(sequence(0L, 49L)) AS col").where("(row*7 + col*3) % 11 <> 0")
        return cells.selectExpr("row", "col", "CAST((row*31 + col*17 + row*col + z) % 97 AS DOUBLE) AS v")

    def lines(self) -> int:
        """Lines of the raster."""
        last = self("part").agg({"p_partkey": "max"}).first()[0]
        return 0 if last is None else int(last) + 1


def _replaced(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b{name}\b", "{" + name + "}", text)


#: The same pixels, and the number of lines, for the oracle engine.
PIX = "px AS (SELECT p_partkey AS row, p_size AS z, unnest(range(50)) AS col FROM part), pix AS (SELECT row, col, CAST((row*31 + col*17 + row*col + z) % 97 AS DOUBLE) AS v FROM px WHERE (row*7 + col*3) % 11 <> 0), lines AS (SELECT max(row) + 1 AS h FROM px)"


def with_views(*names: str, more: str = "") -> str:
    return "WITH " + ", ".join([*(f"{n} AS ({VIEWS[n]})" for n in names), *([more] if more else [])])


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
