"""Vector (GeoPackage), raster (GeoTIFF) and grid (NetCDF classic) files.

Files are read as binary rows and decoded by executors, one file at a time; the
results are long tables.  Writers make single files, for exchange with other
tools; ``parts`` has those that run on executors.  Only the subset named in each
docstring is understood.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiles import Layout


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- GeoPackage: polygons and points -----------------------------------------------------------------


def wkb_parts(blob: bytes) -> list[list[list[tuple[float, float]]]]:
    """Parts of a GeoPackage or plain WKB polygon or multipolygon, each its outer ring and its holes; a point is a ring of one."""
    if blob[:2] == b"GP":
        envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
        blob = blob[8 + envelope :]

    def geometry(at):
        order = "<" if blob[at] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", blob, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            return [[[struct.unpack_from(f"{order}dd", blob, at)]]], at + 16
        n = struct.unpack_from(f"{order}I", blob, at)[0]
        at += 4
        out = []
        for i in range(n):
            if kind == 3:
                m = struct.unpack_from(f"{order}I", blob, at)[0]
                v = struct.unpack_from(f"{order}{2 * m}d", blob, at + 4)
                at += 4 + 16 * m
                if i == 0:
                    out.append([])
                out[0].append(list(zip(v[::2], v[1::2], strict=True)))
            else:
                part, at = geometry(at)
                out += part
        return out, at

    return geometry(0)[0] if blob else []


def polygon_wkb(ring: list[tuple[float, float]]) -> bytes:
    body = struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return b"GP\x00\x01" + struct.pack("<i", 0) + b"\x01" + struct.pack("<II", 3, 1) + body


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: str, geometry: str = "geom") -> DataFrame:
    """``columns`` (DDL) of a layer and ring array<struct<x, y>>, the outer ring of the largest part, and parts, all parts with all rings (outer first).

    ``ring`` suits buildings; perimeters need ``parts``.  Rings are not repaired.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                rows = con.execute(f'SELECT {", ".join(f"""\"{n}\"""" for n in names)}, "{geometry}" FROM "{layer}"').fetchall()
                area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)))
                parts_ = [wkb_parts(bytes(r[-1])) if r[-1] else None for r in rows]
                points = lambda r: [{"x": x, "y": y} for x, y in r]
                rings = [max((p[0] for p in ps), key=area, default=None) if ps else None for ps in parts_]
                out = pd.DataFrame([r[:-1] for r in rows], columns=names)
                out["ring"] = [None if r is None else points(r) for r in rings]
                out["parts"] = [None if ps is None else [[points(r) for r in p] for p in ps] for ps in parts_]
                yield out

    return _binary(spark, path).mapInPandas(decode, f"{columns}, ring array<struct<x:double,y:double>>, parts array<array<array<struct<x:double,y:double>>>>")


def geopackage_bytes(layer: str, rows: list[tuple], columns: list[str]) -> bytes:
    """A layer as the bytes of a file: rows of values and, last, a ring as (x, y) pairs or nothing."""
    con = sqlite3.connect(":memory:")
    con.execute(f'CREATE TABLE "{layer}" ({", ".join(columns)}, geom BLOB)')
    con.executemany(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (len(columns) + 1))})', [(*r[:-1], polygon_wkb(r[-1]) if r[-1] else None) for r in rows])
    con.commit()
    out = con.serialize()
    con.close()
    return out


def write_geopackage(path: str, layer: str, rows: list[tuple], columns: list[str]) -> None:
    """A small layer in one file."""
    with open(path, "wb") as f:
        f.write(geopackage_bytes(layer, rows, columns))


# --- GeoTIFF: one band, stripped or tiled, raw or deflate -------------------------------------------


def tiff_band(data: bytes):
    """(array, x0, y0, x step, y step, nodata) of the first band."""
    lay = Layout(lambda at, size: data[at : at + size])
    out = np.zeros((-(-lay.height // lay.tile_height) * lay.tile_height, lay.across * lay.tile_width), lay.dtype)
    for i, (at, size) in enumerate(zip(lay.offsets, lay.sizes, strict=True)):
        if not size:
            continue
        a, r, c = lay.block(data[at : at + size]), i // lay.across * lay.tile_height, i % lay.across * lay.tile_width
        out[r : r + len(a), c : c + lay.tile_width] = a
    return out[: lay.height, : lay.width], lay.x0, lay.y0, lay.dx, lay.dy, lay.nodata


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, x, y (pixel centres), v double: nodata is null."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                a, x0, y0, dx, dy, nodata = tiff_band(bytes(content))
                for r0 in range(0, len(a), 256):
                    block = a[r0 : r0 + 256].astype(float)
                    if nodata is not None:
                        block[block == nodata] = np.nan
                    r, c = np.mgrid[r0 : r0 + len(block), 0 : a.shape[1]]
                    yield pd.DataFrame({"path": name, "row": r.ravel(), "col": c.ravel(), "x": x0 + (c.ravel() + 0.5) * dx, "y": y0 - (r.ravel() + 0.5) * dy, "v": block.ravel()})

    return _binary(spark, path).mapInPandas(decode, "path string, row long, col long, x double, y double, v double").withColumn("v", F.nanvl("v", F.lit(None)))


def geotiff_bytes(a: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, tile: int | None = None) -> bytes:
    """The bytes of a file: one deflated strip, or deflated blocks of ``tile`` x ``tile`` (a multiple of 16)."""
    a = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<")))
    h, w = a.shape
    if tile:
        full = np.full((-(-h // tile) * tile, -(-w // tile) * tile), nodata or 0, a.dtype)
        full[:h, :w] = a
        bodies = [zlib.compress(np.ascontiguousarray(full[r : r + tile, c : c + tile]).tobytes()) for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        bodies = [zlib.compress(a.tobytes())]
    at = (8 + np.cumsum([0, *map(len, bodies[:-1])])).tolist()
    body = b"".join(bodies)
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    where, sizes = (4, tuple(at)), (4, tuple(map(len, bodies)))
    blocks = [(322, 4, (tile,)), (323, 4, (tile,)), (324, *where), (325, *sizes)] if tile else [(273, *where), (278, 4, (h,)), (279, *sizes)]
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (a.dtype.itemsize * 8,)), (259, 3, (8,)), (262, 3, (1,)), (277, 3, (1,)), *blocks, (339, 3, (form,)), (33550, 12, (dx, dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0))]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    directory, extra = b"", b""
    start = 8 + len(body) + len(body) % 2
    spill = start + 2 + 12 * len(tags) + 4
    for tag, kind, v in sorted(tags, key=lambda t: t[0]):
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *v)
        if len(raw) > 4:
            place, extra = struct.pack("<I", spill + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, len(v)) + place
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + directory + struct.pack("<I", 0) + extra


def write_geotiff(path: str, a: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None) -> None:
    with open(path, "wb") as f:
        f.write(geotiff_bytes(a, x0, y0, dx, dy, nodata))


# --- NetCDF classic -----------------------------------------------------------------------------------

_NC = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_variables(data: bytes) -> dict[str, tuple[tuple[str, ...], np.ndarray, dict]]:
    """name: (dimensions, values, attributes) of a CDF-1 or CDF-2 file without a record dimension."""
    if data[:3] != b"CDF":
        raise ValueError("not a NetCDF classic file")
    wide, at = data[3] == 2, 8

    def integer():
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def text():
        nonlocal at
        n = integer()
        out = data[at : at + n].decode()
        at += -(-n // 4) * 4
        return out

    def attributes():
        nonlocal at
        out = {}
        integer()
        for _ in range(integer()):
            name, kind, n = text(), integer(), integer()
            dt = np.dtype(_NC[kind])
            raw = data[at : at + n * dt.itemsize]
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, dt)
            at += -(-n * dt.itemsize // 4) * 4
        return out

    integer()
    dims = [(text(), integer()) for _ in range(integer())]
    attributes()
    integer()
    out = {}
    for _ in range(integer()):
        name = text()
        own = [integer() for _ in range(integer())]
        attrs, kind, _ = attributes(), integer(), integer()
        begin = struct.unpack_from(">q" if wide else ">i", data, at)[0]
        at += 8 if wide else 4
        shape = tuple(dims[d][1] for d in own)
        out[name] = (tuple(dims[d][0] for d in own), np.frombuffer(data, _NC[kind], int(np.prod(shape)), begin).reshape(shape), attrs)
    return out


def netcdf_bytes(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, str]]) -> bytes:
    """Doubles only; each variable may carry units."""
    names = list(dims)

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(names)) + b"".join(text(n) + struct.pack(">i", dims[n]) for n in names) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))
    parts = []
    for name, (own, values, units) in variables.items():
        attrs = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">i", 2) + text(units) if units else struct.pack(">ii", 0, 0)
        parts.append((text(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(d)) for d in own) + attrs + struct.pack(">ii", 6, values.size * 8), values.astype(">f8").tobytes()))
    begin = len(head) + sum(len(p) + 8 for p, _ in parts)
    body = b""
    for p, raw in parts:
        head += p + struct.pack(">q", begin + len(body))
        body += raw
    return head + body


def write_netcdf(path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, str]]) -> None:
    with open(path, "wb") as f:
        f.write(netcdf_bytes(dims, variables))


def read_netcdf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """ts, latitude, longitude and ``columns``, long form, of all files under ``path``; NaN is null.

    The time dimension is called time or valid_time, in hours or days since an epoch.
    """

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf["content"]:
                v = netcdf_variables(bytes(content))
                t = v["valid_time" if "valid_time" in v else "time"]
                unit, _, epoch = t[2].get("units", "hours since 1970-01-01").partition(" since ")
                ts = pd.Timestamp(epoch.strip()) + pd.to_timedelta(t[1].astype(float), unit={"hours": "h", "days": "D", "seconds": "s"}[unit.strip()])
                lat, lon = v["latitude"][1].astype(float), v["longitude"][1].astype(float)
                for i, when in enumerate(ts):
                    grid = {c: v[c][1][i].ravel().astype(float) for c in columns}
                    yield pd.DataFrame({"ts": when, "latitude": np.repeat(lat, len(lon)), "longitude": np.tile(lon, len(lat)), **grid})

    rows = _binary(spark, path).mapInPandas(decode, "ts timestamp, latitude double, longitude double, " + ", ".join(f"{c} double" for c in columns))
    return rows.select("ts", "latitude", "longitude", *[F.nanvl(c, F.lit(None)).alias(c) for c in columns])
