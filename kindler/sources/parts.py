"""A sink for files that Spark does not write itself: rows of (name, content) become files of one folder.

Tasks write below ``_temporary``; only the commit moves files to their places and
leaves ``_SUCCESS``, and an abort removes them, so a lost or repeated task leaves
nothing behind.  Raster, grid and vector files are made of rows by executors, a
tile, year or part each.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
cloudpickle.register_pickle_by_value(files)


def _store(path: str):
    """(file system, folder) of a path or URI that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: str  # one text, as tasks may write very many


class FileParts(DataSource):
    """``df.write.format("file_parts").mode("append").save(folder)`` for rows of name string, content binary."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Parts(self.options["path"], overwrite)


class _Parts(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        store, folder = _store(self.path)
        own, names = f"{folder}/_temporary/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or "/" in name or "\n" in name or name[0] in "._":
                    raise ValueError(f"not a file name: {name!r}")
                with store.open_output_stream(f"{own}/{name}") as f:
                    f.write(content or b"")
                names.append(name)
        return _Written(own, "\n".join(names))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        written = [m for m in messages if m and m.names]
        hashes = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(hash, m.names.split("\n")), np.int64) for m in written)])
        if len(np.unique(hashes)) < len(hashes) and len({n for m in written for n in m.names.split("\n")}) < len(hashes):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.is_file:
                    store.delete_file(f.path)
        store.create_dir(folder, recursive=True)
        for m in written:
            for name in m.names.split("\n"):
                store.move(f"{m.folder}/{name}", f"{folder}/{name}")
        self._clean()
        with store.open_output_stream(f"{folder}/_SUCCESS") as f:
            f.write(json.dumps({"files": len(hashes)}).encode())

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        if store.get_file_info(f"{folder}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_temporary/{self.job}")


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Files of rows (name, content)."""
    rows.sparkSession.dataSource.register(FileParts)
    rows.select("name", "content").write.format("file_parts").mode(mode).save(folder)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in ``folder``; one task lists them, and the driver sees none."""

    def run(batches):
        import os
        from itertools import islice

        import pyarrow as pa
        from pyarrow import fs

        for _ in batches:
            store, at = _store(folder)
            local = isinstance(store, fs.LocalFileSystem)
            names = (e.name for e in os.scandir(at) if e.is_file()) if local else (f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.is_file)
            while part := list(islice(names, 50_000)):
                yield pa.record_batch([pa.array(part, pa.string())], names=["name"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string")


def with_companion(spark: SparkSession, folder: str, main: str = "_metrics.json", other: str = "_scores.csv") -> DataFrame:
    """(stem) in ``folder`` that have both files, for folders of any size."""
    n, names = F.col("name"), listed(spark, folder)
    ends = F.when(n.endswith(main), F.struct(F.substr(n, F.lit(1), F.length(n) - len(main)).alias("stem"), F.lit(1).alias("of"))).when(n.endswith(other), F.struct(F.substr(n, F.lit(1), F.length(n) - len(other)).alias("stem"), F.lit(2).alias("of")))
    return names.select(ends.alias("e")).where("e is not null").groupBy(F.col("e.stem").alias("stem")).agg(F.bit_or("e.of").alias("of")).where("of = 3").select("stem")


def write_geotiff_tiles(pixels: DataFrame, folder: str, x0: float, y0: float, dx: float, dy: float, tile: int = 256, nodata: float = -9999.0) -> None:
    """Pixels (row, col, v) as GeoTIFF files of at most ``tile`` x ``tile``, one for each tile that has a pixel; missing ones are ``nodata``."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (int(k) * tile for k in key)
        a = np.full((int(pdf["row"].max()) - r + 1, int(pdf["col"].max()) - c + 1), nodata)
        a[pdf["row"].to_numpy() - r, pdf["col"].to_numpy() - c] = pdf["v"].fillna(nodata).to_numpy()
        return pd.DataFrame({"name": [f"tile_{key[0]}_{key[1]}.tif"], "content": [files.geotiff_bytes(a, x0 + c * dx, y0 - r * dy, dx, dy, nodata)]})

    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    p = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))
    write_files(p.groupBy(at("row").alias("_r"), at("col").alias("_c")).applyInPandas(one, "name string, content binary"), folder)


def write_netcdf_years(grid: DataFrame, folder: str, columns: list[str]) -> None:
    """Rows (ts, latitude, longitude and ``columns``) as one NetCDF file for each year and month, on the axes that its rows have; missing cells are NaN."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        axes = {"valid_time": np.sort(pdf["ts"].unique()), "latitude": np.sort(pdf["latitude"].unique())[::-1], "longitude": np.sort(pdf["longitude"].unique())}
        at = (np.searchsorted(axes["valid_time"], pdf["ts"].to_numpy()), len(axes["latitude"]) - 1 - np.searchsorted(axes["latitude"][::-1], pdf["latitude"].to_numpy()), np.searchsorted(axes["longitude"], pdf["longitude"].to_numpy()))
        hours = (axes["valid_time"] - np.datetime64("1970-01-01")) / np.timedelta64(1, "h")
        made = {"valid_time": (("valid_time",), hours.astype(float), "hours since 1970-01-01"), **{a: ((a,), axes[a].astype(float), "") for a in ("latitude", "longitude")}}
        for c in columns:
            v = np.full(tuple(map(len, axes.values())), np.nan)
            v[at] = pdf[c].astype(float)
            made[c] = (tuple(axes), v, "1")
        return pd.DataFrame({"name": [f"grid_{key[0]:04d}_{key[1]:02d}.nc"], "content": [files.netcdf_bytes({a: len(v) for a, v in axes.items()}, made)]})

    made = grid.where("ts is not null and latitude is not null and longitude is not null").select("ts", "latitude", "longitude", *columns)
    write_files(made.groupBy(F.year("ts").alias("_y"), F.month("ts").alias("_m")).applyInPandas(one, "name string, content binary"), folder)


def write_geopackages(rows: DataFrame, folder: str, layer: str, ring: str = "ring", most: int = 50_000) -> None:
    """``rows`` with a polygon in ``ring`` as GeoPackage files of one layer, each with at most ``most`` rows of one task; numbers and strings only."""
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL"}
    columns = [(f.name, kinds.get(f.dataType.simpleString(), "INTEGER")) for f in rows.schema if f.name != ring]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n = 0
        for pdf in batches:
            for at in range(0, len(pdf), most):
                part = pdf.iloc[at : at + most]
                values = [[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in part[c]] for c, _ in columns]
                rings = [None if g is None else [(p["x"], p["y"]) for p in g] for g in part[ring]]
                content = files.geopackage_bytes(layer, list(zip(*values, rings, strict=True)), [f'"{c}" {k}' for c, k in columns])
                yield pd.DataFrame({"name": [f"part_{TaskContext.get().partitionId():05d}_{n:05d}.gpkg"], "content": [content]})
                n += 1

    write_files(rows.select(*[c for c, _ in columns], ring).mapInPandas(run, "name string, content binary"), folder)
