"""Feature services: layers are asked in order, the first one that has features is read, page by page."""

from __future__ import annotations

import json
import sys
import urllib.parse
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .requests import fetch, known_fires

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

POINTS = "array<array<array<struct<x:double,y:double>>>>"
SCHEMA = f"layer string, id string, properties map<string,string>, parts {POINTS}"


def parts_of(geometry: dict | None) -> list | None:
    """Parts of a GeoJSON polygon or multipolygon, each its rings, the outer one first; nothing for other geometries."""
    kind, at = (geometry or {}).get("type"), (geometry or {}).get("coordinates")
    if not at or kind not in ("Polygon", "MultiPolygon"):
        return None
    return [[[(float(p[0]), float(p[1])) for p in ring] for ring in part] for part in ([at] if kind == "Polygon" else at)]


class FeatureLayers(DataSource):
    """``spark.read.format("feature_layers")`` with options url, layers (JSON list, in order of preference), box (west, south, east, north), page (features of a request).

    A layer that does not answer, or not with JSON, is passed over like an empty
    one.  Layers that do not tell how many features match are asked for one page.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Layers(dict(self.options))


class _Layers(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.page = options, int(options.get("page", "2000"))

    def ask(self, layer: str, **more: str) -> dict:
        west, south, east, north = self.options["box"].split(",")
        query = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeName": layer, "BBOX": f"{south},{west},{north},{east},EPSG:4326", "outputFormat": "application/json", **more}
        o = self.options
        body = fetch([f"{o['url']}?{urllib.parse.urlencode(query)}"], None, int(o.get("tries", "2")), float(o.get("wait", "1")), float(o.get("timeout", "60")))
        return json.loads(body)

    def partitions(self) -> list[InputPartition]:
        for layer in json.loads(self.options["layers"]):
            try:
                first = self.ask(layer, count="1", startIndex="0")
                if not first.get("features"):
                    continue
                told = first.get("numberMatched", first.get("totalFeatures"))
                n = int(told) if str(told).isdigit() else self.page
            except (OSError, ValueError, AttributeError):
                continue
            return [InputPartition((layer, at)) for at in range(0, max(n, 1), self.page)]
        return [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        layer, at = partition.value
        for f in self.ask(layer, count=str(self.page), startIndex=str(at)).get("features", []):
            facts = {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in (f.get("properties") or {}).items()}
            yield (layer, None if f.get("id") is None else str(f["id"]), facts, parts_of(f.get("geometry")))


def feature_layers(spark: SparkSession, url: str, layers: list[str], box: tuple[float, float, float, float], page: int = 2000, **options: str) -> DataFrame:
    """Features of the first of ``layers`` that has any in ``box``; no rows where none has."""
    spark.dataSource.register(FeatureLayers)
    return spark.read.format("feature_layers").options(url=url, layers=json.dumps(layers), box=",".join(map(str, box)), page=str(page), **options).load()


def fires_or_known(spark: SparkSession, features: DataFrame, date: str = "FIREDATE", area_ha: str = "AREA_HA") -> DataFrame:
    """fire_id, year, area_ha, source, parts of a service's ``features``; of the known fires, as circles, where there are none."""
    from ..functions.geometry import circle_ring, project

    found = features.where("parts is not null").select(
        F.coalesce("id", F.col("properties")["id"]).alias("fire_id"), F.try_to_date(F.substring(F.col("properties")[date], 1, 10)).alias("day"),
        F.expr(f"try_cast(properties['{area_ha}'] as double)").alias("area_ha"), F.concat(F.lit("service layer "), F.col("layer")).alias("source"), "parts",
    ).select("fire_id", F.year("day").alias("year"), "area_ha", "source", "parts")
    if not found.isEmpty():
        return found
    k = known_fires(spark)
    p = project(F.col("lon"), F.col("lat"))
    return k.select("fire_id", "year", "area_ha", F.col("reference").alias("source"), F.array(F.array(circle_ring(p["x"], p["y"], F.col("radius_m")))).alias("parts"))
