"""Active-fire detections, fetched by day and appended as they come: a streaming source whose offset is the next day to fetch.

A micro-batch asks for the days between two offsets, a request for each batch of
days and a partition for each request.  Spark writes the offset before and commits
it after the rows are appended, so a run that was stopped goes on with the days
that are missing, and none comes twice.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .requests import fetch

#: Columns without which an answer is refused, and all that are kept.
REQUIRED = ("latitude", "longitude", "acq_date")
SCHEMA = "latitude double, longitude double, acq_date date, acq_time string, frp double, confidence string, batch_start date"


def parsed(text: str, start: date) -> Iterator[tuple]:
    """Rows of one answer by the names in its header.

    An empty answer has no rows.  A header without the required columns, an error
    message for instance, is refused, as is a row that can't be read: the batch then
    fails and its days stay open.
    """
    rows = csv.reader(io.StringIO(text.strip()))
    header = [c.strip().lower() for c in next(rows, [])]
    if not header:
        return
    missing = [c for c in REQUIRED if c not in header]
    if missing:
        raise ValueError(f"answer for {start} has no {', '.join(missing)}: {text[:80]!r}")
    at = {c: i for i, c in enumerate(header)}
    number = lambda v: float(v) if v not in (None, "") else None
    for row in rows:
        if len(row) != len(header):
            raise ValueError(f"answer for {start} has a row of {len(row)} fields: {row[:3]}")
        pick = lambda c: row[at[c]].strip() if c in at else None  # noqa: B023, E731
        yield (float(pick("latitude")), float(pick("longitude")), date.fromisoformat(pick("acq_date")), pick("acq_time"), number(pick("frp")), pick("confidence"), start)


class Hotspots(DataSource):
    """``spark.readStream.format("hotspots")`` with options url (with ``{start}`` and ``{days}``; several are separated by blanks), first, last (ISO days, both included), most (days of a request, 5)."""

    @classmethod
    def name(cls) -> str:
        return "hotspots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Days(dict(self.options))


class _Days(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.most = int(options.get("most", "5"))
        self.reached = self.first

    def initialOffset(self) -> dict:
        return {"day": self.first.isoformat()}

    def latestOffset(self) -> dict:
        return {"day": max(self.reached, self.last + timedelta(days=1)).isoformat()}  # never back behind what was planned

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        day, stop, out = date.fromisoformat(start["day"]), date.fromisoformat(end["day"]), []
        self.reached = max(self.reached, stop)
        while day < stop:
            days = min(self.most, (stop - day).days)
            out.append(InputPartition((day.isoformat(), days)))
            day += timedelta(days=days)
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        start, days = partition.value
        o = self.options
        urls = [u.replace("{start}", start).replace("{days}", str(days)) for u in o["url"].split()]
        body = fetch(urls, None, int(o.get("tries", "4")), float(o.get("wait", "1")), float(o.get("timeout", "60")))
        yield from parsed(body.decode("utf-8-sig"), date.fromisoformat(start))

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, date.fromisoformat(end["day"]))  # Spark's checkpoint keeps it


def committed_day(spark: SparkSession, checkpoint: str) -> date | None:
    """The day from which on nothing is committed yet in a query's checkpoint; none for a new one."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = store.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in fs.listStatus(store) if f.getPath().getName().isdigit()] if fs.exists(store) else []
    if not done:
        return None
    lines = [r[0] for r in spark.read.text(f"{checkpoint}/offsets/{max(done)}").collect()]  # a few lines
    return next(date.fromisoformat(json.loads(x)["day"]) for x in reversed(lines) if '"day"' in x)


def append_hotspots(spark: SparkSession, url: str, folder: str, checkpoint: str, first: str, last: str, most: int = 5, step: int = 365, **options: str) -> DataFrame:
    """All detections of [first, last] as a Parquet table at ``folder``; only days that it does not have yet are fetched.

    Days are appended in steps, each committed on its own: what a step has fetched
    stays when a later one fails.  ``first`` and ``most`` must not change between runs.
    """
    spark.dataSource.register(Hotspots)
    begin, end = committed_day(spark, checkpoint) or date.fromisoformat(first), date.fromisoformat(last)
    while begin <= end:
        until = min(end, begin + timedelta(days=step - 1))
        reader = spark.readStream.format("hotspots").options(url=url, first=first, last=until.isoformat(), most=str(most), **options)
        query = reader.load().writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        begin = until + timedelta(days=1)
    return spark.read.schema(SCHEMA).parquet(folder)
