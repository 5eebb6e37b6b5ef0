import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindler.sources import files, readers, requests
from kindler.streaming import weather


def test_geopackage_round_trip(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    files.write_geopackage(str(tmp_path / "b.gpkg"), "buildings", [(1, "house", ring), (2, None, ring)], ["id", "use"])
    rows = files.read_geopackage(spark, str(tmp_path / "b.gpkg"), "buildings", "id long, use string").orderBy("id").collect()
    assert [(r["id"], r["use"]) for r in rows] == [(1, "house"), (2, None)]
    assert [(p["x"], p["y"]) for p in rows[0]["ring"]] == ring


def test_geopackage_parts_and_holes(spark, tmp_path):
    import sqlite3
    import struct

    from kindler.operators import model, spatial

    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    wkb = lambda rings: b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    parts = [[box(0.0, 10.0), box(4.0, 6.0)], [box(20.0, 22.0)]]
    con = sqlite3.connect(str(tmp_path / "f.gpkg"))
    con.execute("CREATE TABLE fires (id INTEGER, geom BLOB)")
    con.execute("INSERT INTO fires VALUES (1, ?)", [b"GP\x00\x01" + struct.pack("<i", 0) + b"\x01" + struct.pack("<II", 6, 2) + b"".join(map(wkb, parts))])
    con.commit()
    con.close()
    d = files.read_geopackage(spark, str(tmp_path / "f.gpkg"), "fires", "id long")
    row = d.first()
    assert [[[tuple(p) for p in r] for r in part] for part in row["parts"]] == parts and [tuple(p) for p in row["ring"]] == parts[0][0]
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 21.0, 21.0), (4, 15.0, 15.0)], "i long, x double, y double")
    assert {r["i"]: r["burned"] for r in spatial.label_inside(points, d, "i", "id").collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    assert (len(model.STRUCTURAL), len(model.DYNAMIC), len(model.ALL), len(model.LEAVE_ONE_OUT)) == (21, 5, 26, 21)


def test_geotiff_round_trip(spark, tmp_path):
    a = np.arange(300 * 7, dtype=np.float32).reshape(300, 7)
    a[3, 4] = -9999
    files.write_geotiff(str(tmp_path / "d.tif"), a, 100.0, 500.0, 10.0, 10.0, nodata=-9999)
    d = files.read_geotiff(spark, str(tmp_path / "d.tif"))
    assert d.count() == a.size and d.where("v is null").select("row", "col").collect() == [(3, 4)]
    r = d.where("row = 299 and col = 6").first()
    assert (r["v"], r["x"], r["y"]) == (float(a[299, 6]), 165.0, 500 - 2995.0)


def test_netcdf_round_trip(spark, tmp_path):
    v = np.arange(2 * 3 * 2, dtype=float).reshape(2, 3, 2)
    v[0, 0, 0] = np.nan
    dims = {"valid_time": 2, "latitude": 3, "longitude": 2}
    files.write_netcdf(str(tmp_path / "w.nc"), dims, {"valid_time": (("valid_time",), np.array([0.0, 24.0]), "hours since 2018-07-22"), "latitude": (("latitude",), np.array([38.2, 38.1, 38.0]), ""), "longitude": (("longitude",), np.array([23.9, 24.0]), ""), "fwi": (("valid_time", "latitude", "longitude"), v, "1")})
    d = files.read_netcdf(spark, str(tmp_path), ["fwi"])
    assert d.count() == 12 and d.where("fwi is null").count() == 1
    assert d.where("ts = timestamp'2018-07-23' and latitude = 38.0 and longitude = 24.0").first()["fwi"] == 11.0


def test_http_chunks_retry_and_parse(spark):
    answer = {"elements": [{"type": "way", "id": 5, "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}], "tags": {"building": "House"}}, {"type": "node", "id": 6}]}
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            calls.append(self.rfile.read(int(self.headers["Content-Length"])))
            ok = len(calls) > 1
            self.send_response(200 if ok else 504)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode() if ok else b"busy")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(requests.HttpChunks)
    d = spark.read.format("http_chunks").option("urls", f"http://127.0.0.1:{server.server_port}/").option("bodies", "one\ntwo").option("wait", "0.05").load()
    rows = requests.overpass_buildings(d).collect()
    server.shutdown()
    assert [(r["osm_id"], r["building_use"], len(r["ring"])) for r in rows] == [(5, "residential", 4)]
    assert len(calls) >= 3


def test_stac(spark):
    body = json.dumps({"features": [{"id": "a", "assets": {"data": {"href": "s3://b/k/x.tif"}}}, {"id": "c", "assets": {"data": {"href": "http://h/y"}}}, {"id": "d"}]})
    d = requests.stac_tiles(spark.createDataFrame([(body,)], "body string"), "eu-central-1")
    assert {r["tile_id"]: r["url"] for r in d.collect()} == {"a": "https://b.s3.eu-central-1.amazonaws.com/k/x.tif", "c": "http://h/y"}


def test_known_fires(spark):
    d = requests.known_fires(spark)
    assert d.count() == 27 and d.where("fire_id = 'EFFIS_20180723_009'").first()["area_ha"] == 1290.0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("e1", 1, 0.5), ("e2", 2, 0.25)], "event_id string, k int, s double")
    path = str(tmp_path / "t")
    readers.upsert_events(d, path)
    after = readers.upsert_events(d.where("event_id = 'e2'").withColumn("s", F.lit(9.0)), path)
    assert {(r["event_id"], r["s"]) for r in after.collect()} == {("e1", 0.5), ("e2", 9.0)}
    readers.write_csv(d, str(tmp_path / "c"), 4)
    assert readers.scan_csv(spark, str(tmp_path / "c"), "event_id string, k int, s string").where("k = 1").first()["s"] == "0.5000"
    readers.write_metrics(d, str(tmp_path / "m"))
    assert readers.scan_json(spark, str(tmp_path / "m"), lines=True).count() == 2
    made = []
    make = lambda: made.append(1) or d
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "x"), make).count() == 2
    assert len(made) == 1
    assert readers.replace_table(d, "kq_sink").count() == 2
    assert "| e1 | 1 | 0.5000 |" in readers.report("R", [("S", d)])
    (tmp_path / "ev").mkdir()
    for n in ("a_metrics.json", "a_scores.csv", "b_metrics.json"):
        (tmp_path / "ev" / n).write_text("")
    assert readers.events_with_companion(spark, str(tmp_path / "ev")) == ["a"]
    assert "valid_time" not in readers.time_of(spark.createDataFrame([(1,)], "valid_time int")).columns
    with pytest.raises(ValueError):
        readers.time_of(d)


def test_streaming_codes_equal_batch(spark, tmp_path):
    from kindler.functions.fire_weather import daily_codes

    rows = [(c, f"2018-07-{d:02d}", 20.0 + d + c, 40.0 + c, 10.0, float(d % 4)) for c in (1, 2) for d in range(1, 9)]
    w = spark.createDataFrame(rows, "cell long, day string, t double, h double, wind double, rain double").withColumn("day", F.to_date("day"))
    for i, days in enumerate((4, 8)):
        w.where(F.day("day").between(days - 3, days)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(w.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = weather.stream_codes(stream).writeStream.format("memory").queryName("codes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r["cell"], str(r["day"]), round(r["fwi"], 3)) for r in d.collect())
    assert key(spark.table("codes")) == key(daily_codes(w))


def test_streaming_windows(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 05:00:00", 2.0)], "ts string, value double").select(F.col("ts").cast("timestamp"), F.lit(1).alias("cell"), "value")
    d.write.parquet(str(tmp_path / "in"))
    s = weather.windowed(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "1 hour", "2 hours")
    q = s.writeStream.format("memory").queryName("wins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [1, 2]


def test_config(tmp_path):
    from kindler.config import bbox, load_config

    (tmp_path / "area.json").write_text('{"bbox": [23.4, 37.6, 24.2, 38.3], "name": "x"}')
    c = load_config(str(tmp_path), {"aoi": "area"}, {"aoi": {"name": "y"}, "seed": 42})
    assert bbox(c) == (23.4, 37.6, 24.2, 38.3) and c["aoi"]["name"] == "y" and c["seed"] == 42
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path), {"a": "none"})


def test_file_parts_commit_and_abort(spark, tmp_path):
    from kindler.sources import parts

    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", b"one"), ("b.txt", None)], "name string, content binary").repartition(2)
    parts.write_files(rows, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_file()) == ["_SUCCESS", "a.txt", "b.txt"]
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"one" and (tmp_path / "out" / "b.txt").read_bytes() == b""
    for bad in ([("c.txt", b"x"), ("d/e", b"x")], [("c.txt", b"x"), ("c.txt", b"y")]):
        with pytest.raises(Exception, match="file name"):
            parts.write_files(spark.createDataFrame(bad, "name string, content binary").repartition(2), folder)
        assert not (tmp_path / "out" / "c.txt").exists()
    assert not [p for p in (tmp_path / "out" / "_temporary").iterdir() if any(p.rglob("*.txt"))]
    parts.write_files(rows.where("name = 'a.txt'"), folder, "overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_file()) == ["_SUCCESS", "a.txt"]


def test_layers_of_executors(spark, tmp_path):
    from kindler.sources import parts

    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]
    d = spark.createDataFrame([(1, "house", 0.5, ring), (2, None, None, None), (3, "o'x", 1.5, ring)], "id long, use string, h double, ring array<struct<x:double,y:double>>").repartition(2)
    parts.write_geopackages(d, str(tmp_path / "g"), "b", most=1)
    back = files.read_geopackage(spark, str(tmp_path / "g" / "*.gpkg"), "b", "id long, use string, h double").orderBy("id").collect()
    assert [(r["id"], r["use"], None if r["h"] is None or r["h"] != r["h"] else r["h"], r["ring"] is not None) for r in back] == [(1, "house", 0.5, True), (2, None, None, False), (3, "o'x", 1.5, True)]
    pixels = spark.createDataFrame([(0, 0, 1.0), (5, 9, 2.0), (6, 3, None)], "row int, col int, v double")
    parts.write_geotiff_tiles(pixels, str(tmp_path / "t"), 0.0, 100.0, 1.0, 1.0, tile=4)
    tiles = files.read_geotiff(spark, str(tmp_path / "t" / "*.tif")).where("v is not null").select("x", "y", "v").collect()
    assert sorted(map(tuple, tiles)) == [(0.5, 99.5, 1.0), (9.5, 94.5, 2.0)]


@pytest.fixture
def archive():
    """A server of detections by day; ``asked`` has the requests, ``bad`` days that get an error message, ``down`` days without an answer."""
    from datetime import date, timedelta

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            _, start, days = self.path.strip("/").split("/")
            self.server.asked.append((start, int(days)))
            every = [date.fromisoformat(start) + timedelta(days=i) for i in range(int(days))]
            if any(d.isoformat() in self.server.down for d in every):
                self.send_response(404)
                self.end_headers()
                return
            body = "latitude,longitude,bright_ti4,acq_date,acq_time,frp\n" + "".join(f"38.{d.day},23.5,300,{d},1230,{d.day}.5\n" for d in every if d.day % 2)
            if any(d.isoformat() in self.server.bad for d in every):
                body = "Invalid MAP_KEY."
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.bad, server.down = [], set(), set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}/d/{{start}}/{{days}}"
    yield server
    server.shutdown()


def test_hotspots_are_appended_and_resumed(spark, tmp_path, archive):
    from datetime import date, timedelta

    from kindler.sources import hotspots

    where = (archive.url, str(tmp_path / "t"), str(tmp_path / "c"), "2024-01-01")
    get = lambda last, **o: hotspots.append_hotspots(spark, *where, last, step=10, wait="0.01", **o)
    days = lambda last: sorted(d for i in range((date.fromisoformat(last) - date(2024, 1, 1)).days + 1) if (d := date(2024, 1, 1) + timedelta(days=i)).day % 2)
    assert sorted(r["acq_date"] for r in get("2024-01-12").collect()) == days("2024-01-12")
    assert sorted(archive.asked) == [("2024-01-01", 5), ("2024-01-06", 5), ("2024-01-11", 2)]
    archive.asked.clear()
    assert get("2024-01-12").count() == len(days("2024-01-12")) and not archive.asked  # nothing is missing
    archive.bad.add("2024-01-26")
    with pytest.raises(Exception, match="acq_date"):
        get("2024-02-05")
    kept = spark.read.parquet(where[1])
    assert sorted(r["acq_date"] for r in kept.collect()) == days("2024-01-22")  # the step before the bad one stays
    archive.bad.clear()
    archive.asked.clear()
    rows = get("2024-02-05").collect()
    assert sorted(r["acq_date"] for r in rows) == days("2024-02-05") and min(s for s, _ in archive.asked) == "2024-01-23"
    assert {r["frp"] for r in rows if r["acq_date"] == date(2024, 1, 3)} == {3.5} and {r["confidence"] for r in rows} == {None}
    archive.down.add("2024-02-07")
    with pytest.raises(Exception):  # noqa: B017
        get("2024-02-08", tries="1")


@pytest.mark.parametrize("text", ["", "\n", "latitude,longitude,acq_date\n"])
def test_answers_without_rows(text):
    from datetime import date

    from kindler.sources import hotspots

    assert list(hotspots.parsed(text, date(2024, 1, 1))) == []
    with pytest.raises(ValueError):
        list(hotspots.parsed("latitude,longitude,acq_date\n1,2\n", date(2024, 1, 1)))


@pytest.fixture
def store():
    """Files behind HTTP with byte ranges; ``sent`` counts bytes, ``busy`` paths fail once."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            s, name = self.server, self.path.strip("/")
            if name in s.busy:
                s.busy.discard(name)
                return self.answer(503, b"")
            if name not in s.files:
                return self.answer(404, b"")
            data, asked = s.files[name], self.headers.get("Range")
            if asked and not name.startswith("plain"):
                a, b = (int(v) for v in asked.removeprefix("bytes=").split("-"))
                return self.answer(206, data[a : b + 1])
            return self.answer(200, data)

        def answer(self, code, body):
            self.server.sent += len(body)
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.files, server.busy, server.sent = {}, set(), 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}"
    yield server
    server.shutdown()


def test_raster_tiles_read_only_what_a_box_needs(spark, store):
    from kindler.sources import tiles

    a = np.random.RandomState(1).rand(700, 900)
    a[10, 20] = -9999
    store.files = {"a.tif": files.geotiff_bytes(a, 20.0, 40.0, 0.001, 0.001, -9999.0, tile=64), "plain.tif": files.geotiff_bytes(a[:50, :60].astype(np.int16), 30.0, 40.0, 0.1, 0.1)}
    assert np.array_equal(files.tiff_band(store.files["a.tif"])[0], a)
    store.busy = {"a.tif"}
    at = {"A": [f"{store.url}/gone.tif", f"{store.url}/a.tif"], "B": [f"{store.url}/plain.tif"], "C": [f"{store.url}/none.tif"]}
    d = tiles.raster_tiles(spark, at, (20.1, 39.7, 20.2, 39.8), wait="0.01")
    got = {(r["row"], r["col"]): r["v"] for r in d.collect()}
    want = {(r, c): a[r, c] for r in range(700) for c in range(900) if 39.7 <= 40 - (r + 0.5) * 0.001 <= 39.8 and 20.1 <= 20 + (c + 0.5) * 0.001 <= 20.2}
    assert got == want and len(got) == 10_000
    assert store.sent < 0.25 * len(store.files["a.tif"]) + len(store.files["plain.tif"])
    # bounds in filters reach the source as well
    store.sent = 0
    one = tiles.raster_tiles(spark, {"A": at["A"]}, wait="0.01").where("x >= 20.0 and x < 20.03 and y > 39.98")
    assert one.count() == 600 and store.sent < 120_000
    assert one.where("v is null").select("row", "col").collect() == [(10, 20)]
    assert tiles.raster_tiles(spark, {"B": at["B"], "C": at["C"]}).groupBy("tile").count().collect() == [("B", 3000)]
    with pytest.raises(Exception, match="no address"):
        tiles.raster_tiles(spark, {"C": at["C"]}, missing="fail").count()
    known = spark.createDataFrame([("A", "https://x/a.tif")], "tile_id string, url string")
    assert tiles.addresses(known, ["A", "B"], "https://y/{tile}.tif") == {"A": ["https://x/a.tif", "https://y/A.tif"], "B": ["https://y/B.tif"]}


def test_block_predictors():
    import zlib

    from kindler.sources import tiles

    lay = object.__new__(tiles.Layout)
    a = np.random.RandomState(2).rand(5, 8).astype("<f4")
    lay.tile_width, lay.dtype, lay.packed, lay.predictor = 8, np.dtype("<f4"), 8, 3
    planes = a.astype(">f4").view(np.uint8).reshape(5, 8, 4).transpose(0, 2, 1).reshape(5, 32)
    assert np.array_equal(lay.block(zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes())), a)
    b = np.random.RandomState(3).randint(0, 60_000, (4, 8)).astype("<u2")
    lay.dtype, lay.predictor = np.dtype("<u2"), 2
    assert np.array_equal(lay.block(zlib.compress(np.diff(b, axis=1, prepend=np.uint16(0)).astype("<u2").tobytes())), b)


@pytest.fixture
def service():
    from urllib.parse import parse_qs, urlparse

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            self.server.asked.append((q["typeName"], int(q["startIndex"]), int(q["count"]), q["BBOX"]))
            made = self.server.layers.get(q["typeName"])
            self.send_response(400 if made is None else 200)
            self.end_headers()
            if isinstance(made, list):
                a = int(q["startIndex"])
                made = {"features": made[a : a + int(q["count"])], **({"numberMatched": len(made)} if self.server.tells else {"numberMatched": "unknown"})}
            self.wfile.write(made.encode() if isinstance(made, str) else json.dumps(made or {}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.layers, server.asked, server.tells = {}, [], True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.url = f"http://127.0.0.1:{server.server_port}/wfs"
    yield server
    server.shutdown()


def test_first_layer_with_features_is_read_in_pages(spark, service):
    from kindler.sources import features

    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    square = {"type": "Polygon", "coordinates": [ring, [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]}
    both = {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}
    fires = [{"id": i, "properties": {"FIREDATE": f"20{10 + i % 9}-07-01T00:00", "AREA_HA": 2.5 * i, "name": None}, "geometry": (square, both, None)[i % 3]} for i in range(7)]
    service.layers = {"broken": "<html>no</html>", "empty": [], "fires": fires, "later": fires}
    read = lambda *layers: features.feature_layers(spark, service.url, list(layers), (23.0, 37.0, 24.0, 38.0), page=3, wait="0.01")
    rows = read("gone", "broken", "empty", "fires", "later").collect()
    assert sorted(r["id"] for r in rows) == [str(i) for i in range(7)] and {r["layer"] for r in rows} == {"fires"}
    assert [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in next(r for r in rows if r["id"] == "1")["parts"]] == [[[tuple(map(float, p)) for p in ring]]] * 2
    assert sorted({a[:3] for a in service.asked if a[0] == "fires"}) == [("fires", 0, 1), ("fires", 0, 3), ("fires", 3, 3), ("fires", 6, 3)]
    assert not [a for a in service.asked if a[0] == "later"] and {a[3] for a in service.asked} == {"37.0,23.0,38.0,24.0,EPSG:4326"}
    made = features.fires_or_known(spark, read("fires")).collect()
    assert sorted((r["fire_id"], r["year"], r["area_ha"]) for r in made) == [(str(i), 2010 + i % 9, 2.5 * i) for i in range(7) if i % 3 < 2]
    service.tells = False
    assert read("fires").count() == 3  # one page where the number is not told
    known = features.fires_or_known(spark, read("gone", "empty"))
    assert known.count() == 27 and known.where("size(parts[0][0]) = 256").count() == 27


def test_late_days_give_the_codes_of_the_batch(spark, tmp_path):
    from kindler.functions.fire_weather import daily_codes

    rows = [(c, f"{y}-{m}-{d:02d}", 15.0 + d % 9 + c, 40.0 + c + d % 30, 10.0 + d % 5, float(d % 4) * 2) for c in (1, 2) for y, m, last in ((2018, "12", 31), (2019, "01", 20)) for d in range(20 if m == "12" else 1, last + 1)]
    w = spark.createDataFrame(rows, "cell long, day string, t double, h double, wind double, rain double").select("cell", F.col("day").cast("timestamp").alias("ts"), "t", "h", "wind", "rain")
    batch = daily_codes(w.withColumn("day", F.to_date("ts")).drop("ts"), stored="double")
    # files in an order in which days come up to two days late, one row twice, one far too late, and a last row that closes the stream
    order = sorted(rows, key=lambda r: (r[1][:8] + f"{int(r[1][8:]) + (2 if int(r[1][8:]) % 3 == 0 else 0):02d}", r[0]))
    files_ = [order[i : i + 12] for i in range(0, len(order), 12)]
    files_[2].append(files_[1][0][:2] + (99.0, 1.0, 1.0, 0.0))
    files_ += [[(3, "2018-12-20", 20.0, 40.0, 10.0, 0.0), (4, "2019-03-01", 20.0, 40.0, 10.0, 0.0)], [(4, "2019-03-02", 20.0, 40.0, 10.0, 0.0)]]
    for i, part in enumerate(files_):
        spark.createDataFrame(part, "cell long, day string, t double, h double, wind double, rain double").select("cell", F.col("day").cast("timestamp").alias("ts"), "t", "h", "wind", "rain").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = spark.readStream.schema(w.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = weather.ordered_codes(s).writeStream.format("memory").queryName("late_codes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    key = lambda d: sorted((r["cell"], str(r["day"]), *(round(r[c], 9) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi"))) for r in d.where("cell < 3").collect())
    assert key(spark.table("late_codes")) == key(batch)
    with pytest.raises(ValueError):
        weather.ordered_codes(s, idle=30)
