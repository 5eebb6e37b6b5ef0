"""Raster tiles behind HTTP: only the blocks of an internally tiled GeoTIFF that a box touches are fetched.

A partition is one tile.  It reads the head of the file, finds the blocks under the
box, and asks for their byte ranges; neighbouring ranges are one request.  A tile
has alternative addresses; one that no address knows has no rows.
"""

from __future__ import annotations

import json
import math
import struct
import sys
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

SCHEMA = "tile string, row long, col long, x double, y double, v double"
#: Bytes of a file's head that are asked for first; gaps between blocks up to this size are read along.
HEAD, GAP = 1 << 14, 1 << 12
#: Answers that mean that a tile is not there.
MISSING = (403, 404, 410)


class Layout:
    """Where the blocks of the first band of a TIFF file lie; ``read(offset, size)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, 8)
        if head[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a classic TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        at = struct.unpack_from(f"{self.order}I", head, 4)[0]
        n = struct.unpack_from(f"{self.order}H", read(at, 2))[0]
        entries, tags = read(at + 2, 12 * n), {}
        sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8)}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{self.order}HHI", entries, 12 * i)
            code, width = sizes.get(kind, ("B", 1))
            raw = entries[12 * i + 8 : 12 * i + 12]
            if count * width > 4:
                raw = read(struct.unpack(f"{self.order}I", raw)[0], count * width)
            tags[tag] = raw[:count] if kind == 2 else struct.unpack_from(f"{self.order}{count * len(code)}{code[0]}", raw)
        self.width, self.height = tags[256][0], tags[257][0]
        self.dtype = np.dtype(f"{self.order}{'uif'[tags.get(339, (1,))[0] - 1]}{tags.get(258, (8,))[0] // 8}")
        self.packed, self.predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if self.packed not in (1, 8, 32946):
            raise ValueError(f"compression {self.packed} is not supported")
        tiled = 322 in tags
        self.tile_width, self.tile_height = (tags[322][0], tags[323][0]) if tiled else (self.width, min(tags.get(278, (self.height,))[0], self.height))
        self.offsets, self.sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        self.across = -(-self.width // self.tile_width)
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        self.dx, self.dy = scale[0], scale[1]
        self.x0, self.y0 = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        self.nodata = float(tags[42113].split(b"\0")[0]) if 42113 in tags and tags[42113].strip(b"\0 ") else None

    def block(self, data: bytes) -> np.ndarray:
        """The pixels of one block; strips at the end may be shorter."""
        raw = zlib.decompress(data) if self.packed != 1 else data
        wide = self.tile_width * self.dtype.itemsize
        rows = len(raw) // wide
        if self.predictor == 3:  # bytes of a line's numbers, highest first, as differences
            planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * wide).reshape(rows, wide), axis=1, dtype=np.uint8)
            planes = planes.reshape(rows, self.dtype.itemsize, self.tile_width).transpose(0, 2, 1)
            return np.ascontiguousarray(planes).view(self.dtype.newbyteorder(">")).reshape(rows, self.tile_width)
        a = np.frombuffer(raw, self.dtype, rows * self.tile_width).reshape(rows, self.tile_width)
        return np.cumsum(a, axis=1, dtype=self.dtype) if self.predictor == 2 else a

    def under(self, box: tuple) -> list[int]:
        """Blocks with a pixel centre in the box (west, south, east, north)."""
        west, south, east, north = box
        cols = (max(0, math.ceil((west - self.x0) / self.dx - 0.5)) if west > -math.inf else 0, min(self.width - 1, math.floor((east - self.x0) / self.dx - 0.5)) if east < math.inf else self.width - 1)
        rows = (max(0, math.ceil((self.y0 - north) / self.dy - 0.5)) if north < math.inf else 0, min(self.height - 1, math.floor((self.y0 - south) / self.dy - 0.5)) if south > -math.inf else self.height - 1)
        if cols[0] > cols[1] or rows[0] > rows[1]:
            return []
        return [r * self.across + c for r in range(rows[0] // self.tile_height, rows[1] // self.tile_height + 1) for c in range(cols[0] // self.tile_width, cols[1] // self.tile_width + 1)]


class Ranges:
    """Byte ranges of one file behind one or several addresses; ``None`` for a file that none of them knows."""

    def __init__(self, urls: list[str], tries: int = 4, wait: float = 1.0, timeout: float = 60.0):
        self.urls, self.tries, self.wait, self.timeout, self.head, self.whole = list(urls), tries, wait, timeout, b"", False

    def open(self) -> bool:
        while self.urls:
            try:
                self.head = self.get(0, HEAD)
                return True
            except urllib.error.HTTPError as e:
                if e.code not in MISSING:
                    raise
                self.urls.pop(0)
        return False

    def get(self, at: int, size: int) -> bytes:
        last: Exception | None = None
        for i in range(self.tries):
            try:
                ask = urllib.request.Request(self.urls[0], headers={"Range": f"bytes={at}-{at + size - 1}"})
                with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                    if r.status == 206:
                        return r.read()
                    data = r.read()  # a server that knows no ranges sends all
                    self.head, self.whole = data, True
                    return data if at == 0 else data[at : at + size]
            except (urllib.error.URLError, OSError) as e:
                if isinstance(e, urllib.error.HTTPError) and e.code not in (429, 500, 502, 503, 504):
                    raise
                last = e
                time.sleep(self.wait * 2**i)
        raise OSError(f"no answer from {self.urls[0]} after {self.tries} tries: {last}")

    def read(self, at: int, size: int) -> bytes:
        if self.whole or at + size <= len(self.head):
            return self.head[at : at + size]
        return self.get(at, size)

    def blocks(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """The bytes of each (offset, size), those that lie close together in one request."""
        order = sorted(range(len(ranges)), key=lambda i: ranges[i])
        out, i = [b""] * len(ranges), 0
        while i < len(order):
            j, first, end = i, ranges[order[i]][0], sum(ranges[order[i]])
            while j + 1 < len(order) and ranges[order[j + 1]][0] <= end + GAP:
                j += 1
                end = max(end, sum(ranges[order[j]]))
            data = self.read(first, end - first)
            for k in order[i : j + 1]:
                out[k] = data[ranges[k][0] - first :][: ranges[k][1]]
            i = j + 1
        return out


class RasterTiles(DataSource):
    """``spark.read.format("raster_tiles").option("tiles", json).load()``: pixels of tiles, v null where there is no data.

    ``tiles`` is a JSON object of tile id to its addresses, tried in their order.
    Bounds on x and y that are pushed down, or the option ``box`` (west, south,
    east, north), limit what is fetched; ``missing`` = fail refuses tiles that are
    not there.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Tiles(dict(self.options))


class _Tiles(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.box = tuple(float(v) for v in options["box"].split(",")) if "box" in options else (-math.inf, -math.inf, math.inf, math.inf)

    def pushFilters(self, filters: list) -> Iterator:
        west, south, east, north = self.box
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in ("x", "y"):
                west, south = (max(west, f.value), south) if name == "x" else (west, max(south, f.value))
            if isinstance(f, (LessThan, LessThanOrEqual)) and name in ("x", "y"):
                east, north = (min(east, f.value), north) if name == "x" else (east, min(north, f.value))
            yield f  # pixels of a block may lie beyond the bound: Spark still filters
        self.box = (west, south, east, north)

    def partitions(self) -> list[InputPartition]:
        tiles = json.loads(self.options["tiles"])
        return [InputPartition((tile, urls if isinstance(urls, list) else [urls])) for tile, urls in sorted(tiles.items())] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        if partition.value is None:
            return
        tile, urls = partition.value
        o = self.options
        file = Ranges(urls, int(o.get("tries", "4")), float(o.get("wait", "1")), float(o.get("timeout", "60")))
        if not file.open():
            if o.get("missing") == "fail":
                raise FileNotFoundError(f"no address has tile {tile}")
            return
        lay = Layout(file.read)
        blocks = lay.under(self.box)
        for at in range(0, len(blocks), 64):
            own = blocks[at : at + 64]
            for i, data in zip(own, file.blocks([(lay.offsets[i], lay.sizes[i]) for i in own]), strict=True):
                r0, c0 = i // lay.across * lay.tile_height, i % lay.across * lay.tile_width
                if not data:  # a sparse file leaves empty blocks out
                    continue
                a = lay.block(data)[: lay.height - r0, : lay.width - c0].astype(float)
                if lay.nodata is not None:
                    a[a == lay.nodata] = np.nan
                r, c = (g.ravel() for g in np.mgrid[r0 : r0 + a.shape[0], c0 : c0 + a.shape[1]])
                x, y = lay.x0 + (c + 0.5) * lay.dx, lay.y0 - (r + 0.5) * lay.dy
                west, south, east, north = self.box
                keep = (x >= west) & (x <= east) & (y >= south) & (y <= north)
                v = pa.array(a.ravel()[keep], from_pandas=True)
                yield pa.RecordBatch.from_arrays([pa.array([tile] * int(keep.sum()), pa.string()), pa.array(r[keep]), pa.array(c[keep]), pa.array(x[keep]), pa.array(y[keep]), v], names=[f.split()[0] for f in SCHEMA.split(", ")])


def raster_tiles(spark: SparkSession, tiles: dict[str, list[str]], box: tuple[float, float, float, float] | None = None, **options: str) -> DataFrame:
    """Pixels of ``tiles`` (id to addresses) in ``box``; bounds on x and y in later filters are pushed down too."""
    spark.dataSource.register(RasterTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("raster_tiles").option("tiles", json.dumps(tiles)).options(**options)
    return (reader.option("box", ",".join(map(repr, map(float, box)))) if box else reader).load()


def addresses(discovered: DataFrame, tile_ids: list[str], fallback: str) -> dict[str, list[str]]:
    """Addresses of tiles: what a catalogue's answer (tile_id, url) says first, then ``fallback`` with ``{tile}``; for tiles that it does not know, only that."""
    known = {r["tile_id"]: r["url"] for r in discovered.select("tile_id", "url").collect()}  # a row for each tile of an area
    return {t: [*([known[t]] if t in known else []), fallback.replace("{tile}", t)] for t in dict.fromkeys([*known, *tile_ids])}
