"""Request plans and HTTP chunks.

A plan is a DataFrame with a row for each request; the ``http_chunks`` data
source fetches them in parallel, one partition a request, with back-off over
several endpoints.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def month_requests(spark: SparkSession, first: str, last: str) -> DataFrame:
    """year, month, days of each month that [first, last] touches."""
    months = F.explode(F.sequence(F.trunc(F.to_date(F.lit(first)), "month"), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("m")
    return spark.range(1).select(months).select(F.year("m").alias("year"), F.month("m").alias("month"), F.day(F.last_day("m")).alias("days"))


def event_requests(events: DataFrame, date: str = "event_date") -> DataFrame:
    """``events`` with year, month and days of the requests for the date and the day before: one in the same month, else two."""
    d = events.withColumn("_d", F.explode(F.array(F.date_sub(F.to_date(date), 1), F.to_date(date))))
    g = d.groupBy(*events.columns, F.year("_d").alias("year"), F.month("_d").alias("month"))
    return g.agg(F.sort_array(F.collect_list(F.day("_d"))).alias("days"))


def batches_of(ranges: DataFrame, first: str = "first", last: str = "last", most: int = 5) -> DataFrame:
    """``ranges`` with batch_start and day_count of the batches of at most ``most`` days that cover [first, last]; ranges that end before they begin have none."""
    end = F.to_date(last)
    starts = F.explode(F.sequence(F.to_date(first), end, F.expr(f"interval {int(most)} day"))).alias("batch_start")
    rows = ranges.where(F.to_date(first) <= end).select("*", starts)
    return rows.withColumn("day_count", F.least(F.datediff(end, "batch_start") + 1, F.lit(most)))


def date_batches(spark: SparkSession, first: str, last: str, most: int = 5) -> DataFrame:
    """batch_start, day_count covering [first, last]."""
    return batches_of(spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last")), most=most).select("batch_start", "day_count")


def tiles_of(boxes: DataFrame, step: int = 3) -> DataFrame:
    """``boxes`` (west, south, east, north) with tile_id of every step-degree tile that a box touches, named by its south-west corner."""
    axis = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step) * step, F.floor(F.col(b) / step) * step, F.lit(step).cast("long")))
    t = boxes.where("west <= east and south <= north").withColumn("_lat", axis("south", "north")).withColumn("_lon", axis("west", "east"))
    lat = F.concat(F.when(F.col("_lat") >= 0, "N").otherwise("S"), F.lpad(F.abs("_lat").cast("string"), 2, "0"))
    lon = F.concat(F.when(F.col("_lon") >= 0, "E").otherwise("W"), F.lpad(F.abs("_lon").cast("string"), 3, "0"))
    return t.withColumn("tile_id", F.concat(lat, lon)).drop("_lat", "_lon")


def tiles(spark: SparkSession, west: float, south: float, east: float, north: float, step: int = 3) -> DataFrame:
    """tile_id of all step-degree tiles that the box touches."""
    box = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in (("west", west), ("south", south), ("east", east), ("north", north))])
    return tiles_of(box, step).select("tile_id")


#: Schema of an Overpass answer, a STAC answer and a GeoJSON collection.
OVERPASS = "elements array<struct<type:string,id:bigint,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
STAC = "features array<struct<id:string,assets:struct<data:struct<href:string>>>>"


def overpass_buildings(answers: DataFrame, body: str = "body") -> DataFrame:
    """osm_id, building, building_use and the closed ring of every way; degenerate ways and other elements are left out."""
    from ..functions.geometry import closed
    from ..functions.scalars import building_use

    e = answers.select(F.explode(F.from_json(body, OVERPASS)["elements"]).alias("e")).where("e.type = 'way'")
    ring = F.transform(F.filter("e.geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    tag = F.coalesce(F.col("e.tags")["building"], F.lit("yes"))
    rows = e.select(F.col("e.id").alias("osm_id"), tag.alias("building"), building_use(tag, F.coalesce(F.col("e.tags")["amenity"], F.lit(""))).alias("building_use"), closed(ring).alias("ring"))
    return rows.where("ring is not null").dropDuplicates(["osm_id"])


def stac_tiles(answers: DataFrame, region: str, body: str = "body") -> DataFrame:
    """tile_id, url of the data asset; s3 addresses as https, others than http(s) left out."""
    f = answers.select(F.explode(F.from_json(body, STAC)["features"]).alias("f")).select(F.coalesce(F.col("f.id"), F.lit("")).alias("tile_id"), F.coalesce(F.col("f.assets.data.href"), F.lit("")).alias("href"))
    url = F.regexp_replace("href", r"^s3://([^/]+)/?(.*)$", f"https://$1.s3.{region}.amazonaws.com/$2")
    return f.select("tile_id", url.alias("url")).where("url like 'http%'")


def fetch(urls: list[str], data: bytes | None, tries: int, wait: float, timeout: float) -> bytes:
    """The body from the first address that answers; addresses take turns, waits double."""
    last: Exception | None = None
    for i in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(urls[i % len(urls)], data=data), timeout=timeout) as r:
                return r.read()
        except (urllib.error.URLError, OSError) as e:
            if isinstance(e, urllib.error.HTTPError) and e.code not in (429, 500, 502, 503, 504):
                raise
            last = e
            time.sleep(wait * 2**i)
    raise OSError(f"no answer after {tries} tries: {last}")


class HttpChunks(DataSource):
    """``spark.read.format("http_chunks").option("urls", "a b").option("bodies", "x\\ny").load()``: chunk, body.

    ``urls`` are alternatives, separated by blanks; ``bodies`` has a POST body for
    each chunk (none: one GET).
    """

    @classmethod
    def name(cls) -> str:
        return "http_chunks"

    def schema(self) -> str:
        return "chunk int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Chunks(dict(self.options))


class _Chunks(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        bodies = self.options.get("bodies", "").split("\n")
        return [InputPartition((i, b)) for i, b in enumerate(bodies)]

    def read(self, partition) -> Iterator[tuple]:
        i, body = partition.value
        o = self.options
        got = fetch(o["urls"].split(), body.encode() or None, int(o.get("tries", "4")), float(o.get("wait", "1")), float(o.get("timeout", "60")))
        yield (i, got.decode())


#: Date, region, longitude, latitude, area in km2, reference of known fires.
KNOWN_FIRES = [
    ("2000-07-12", "Attica (Penteli)", 23.87, 38.06, 5.0, "EFFIS Annual Report 2000"),
    ("2002-08-15", "Attica (Varibobi/Tatoi)", 23.79, 38.12, 8.5, "EFFIS Annual Report 2002"),
    ("2003-09-02", "Attica (Grammatiko)", 23.94, 38.105, 3.2, "EFFIS Annual Report 2003"),
    ("2007-08-27", "Attica (Hymettus S slopes)", 23.82, 37.94, 12.0, "EFFIS Annual Report 2007"),
    ("2009-08-21", "Attica (Penteli-Agios Stefanos)", 23.869, 38.074, 15.5, "EFFIS Annual Report 2009"),
    ("2012-07-01", "Attica (Vari)", 23.82, 37.84, 4.0, "EFFIS Annual Report 2012"),
    ("2015-08-17", "Attica (Kalamos)", 23.926, 38.171, 22.0, "EFFIS Annual Report 2015"),
    ("2017-07-19", "Attica (Kineta coast)", 23.23, 38.0, 8.5, "EFFIS Annual Report 2017"),
    ("2018-07-23", "Attica (Mati-Rafina)", 23.978, 38.058, 12.9, "EMSR300; Papageorgiou et al. 2020"),
    ("2018-07-23", "Attica (Kineta-Loutraki)", 23.06, 38.01, 53.0, "EFFIS Annual Report 2018; EMSR299"),
    ("2019-07-24", "Attica (Geraneia range)", 23.1, 38.02, 6.0, "EFFIS Annual Report 2019"),
    ("2020-08-09", "Attica (Grammatiko-Kapandriti)", 23.947, 38.117, 3.1, "EFFIS Annual Report 2020"),
    ("2021-08-03", "Attica (Varibobi)", 23.793, 38.136, 63.0, "EMSR531; EFFIS Annual Report 2021"),
    ("2021-08-23", "Attica (Acharnes-Ano Liosia)", 23.739, 38.087, 24.5, "EFFIS Annual Report 2021"),
    ("2022-07-19", "Attica (Dadia-adjacent)", 23.95, 38.21, 2.5, "EFFIS Annual Report 2022"),
    ("2023-07-18", "Attica (Loutraki)", 22.98, 37.98, 5.5, "EFFIS Annual Report 2023"),
    ("2000-07-15", "Peloponnese (Ilia)", 21.65, 37.7, 850.0, "EFFIS Annual Report 2000"),
    ("2007-08-24", "Peloponnese (Archaia Olympia)", 21.63, 37.64, 27000.0, "EFFIS Annual Report 2007; Karavanas et al. 2014"),
    ("2007-08-28", "Euboea", 23.78, 38.56, 5800.0, "EFFIS Annual Report 2007"),
    ("2009-08-23", "Euboea (N)", 23.3, 38.9, 3200.0, "EFFIS Annual Report 2009"),
    ("2012-08-26", "Chalkidiki", 23.72, 40.2, 7500.0, "EFFIS Annual Report 2012"),
    ("2017-07-17", "Lesbos", 26.4, 39.1, 6800.0, "EFFIS Annual Report 2017"),
    ("2019-08-13", "North Euboea", 23.4, 38.9, 12000.0, "EFFIS Annual Report 2019"),
    ("2021-08-05", "Euboea (NE)", 23.85, 38.73, 51000.0, "EMSR534; EFFIS Annual Report 2021 — largest EU fire 2021"),
    ("2022-07-23", "Lesbos (Vrisa)", 26.35, 39.05, 11000.0, "EFFIS Annual Report 2022"),
    ("2023-08-21", "Alexandroupolis (Evros)", 26.13, 41.0, 81000.0, "EMSR667; EFFIS Annual Report 2023 — largest EU fire in 2023"),
    ("2024-07-28", "Rhodes-Dodecanese area", 28.1, 36.2, 4500.0, "EFFIS Annual Report 2024 preliminary"),
]


def known_fires(spark: SparkSession) -> DataFrame:
    """fire_id, event_date, year, country, region, lon, lat, area_ha, area_km2, radius_m, source, reference."""
    from ..functions.scalars import circle_radius_m, event_id

    rows = [(i, *row) for i, row in enumerate(KNOWN_FIRES, 1)]
    d = spark.createDataFrame(rows, "i int, event_date string, region string, lon double, lat double, area_km2 double, reference string")
    area = F.col("area_km2")
    return d.select(event_id("event_date", "i").alias("fire_id"), "event_date", F.substring("event_date", 1, 4).cast("int").alias("year"), F.lit("GR").alias("country"), "region", "lon", "lat", F.round(area * 100, 1).alias("area_ha"), F.round(area, 2).alias("area_km2"), circle_radius_m(area).alias("radius_m"), F.lit("literature_proxy").alias("source"), "reference")
