"""Streams of weather rows: event-time windows with late data, and the fire-weather recursion with state by cell."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import fire_weather as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and maximum of value by cell and tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "cell").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high"))


def _next(codes: tuple, t: float, h: float, wind: float, rain: float, month: int) -> tuple:
    """FFMC, DMC and DC of one day from those of the day before."""
    t, h, wind, rain, ffmc, dmc, dc = (W.np.float64(v) for v in (t, h, wind, rain, *codes))
    with W.np.errstate(all="ignore"):
        made = W.ffmc_next(ffmc, t, h, wind, rain, W.Arrays), W.dmc_next(dmc, t, h, rain, month, W.Arrays), W.dc_next(dc, t, rain, month, W.Arrays)
    return tuple(float(v) for v in made)


_BEGIN = (W.START["ffmc"], W.START["dmc"], W.START["dc"])
#: What the recursion hands on; the closing indices follow from it without state.
_CARRIED = "cell long, day date, wind double, ffmc double, dmc double, dc double"


def _closed(codes: DataFrame) -> DataFrame:
    i, u = W.isi(F.col("ffmc"), F.col("wind")), W.bui(F.col("dmc"), F.col("dc"))
    return codes.select("cell", "day", "ffmc", "dmc", "dc", i.alias("isi"), u.alias("bui"), W.fwi(i, u).alias("fwi"))


def _codes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    year, *now = state.get if state.exists else (0, *_BEGIN)
    rows = pd.concat(list(parts)).sort_values("day")
    out = []
    for day, t, h, w, r in rows[["day", "t", "h", "wind", "rain"]].itertuples(index=False):
        if day.year != year:
            year, now = day.year, _BEGIN
        now = _next(tuple(now), t, h, w, r, day.month)
        out.append((key[0], day, w, *now))
    state.update((year, *now))
    yield pd.DataFrame(out, columns=["cell", "day", "wind", "ffmc", "dmc", "dc"])


def stream_codes(stream: DataFrame) -> DataFrame:
    """Codes for a stream of (cell, day, t, h, wind, rain) whose days come in order; state is three numbers and a year by cell."""
    made = stream.groupBy("cell").applyInPandasWithState(_codes, _CARRIED, "year int, ffmc double, dmc double, dc double", "append", GroupStateTimeout.NoTimeout)
    return _closed(made)


_DAY_MS = 86_400_000


class _Recursion(StatefulProcessor):
    """Days wait by cell until the watermark has passed them, and are then taken in their order."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "day long, ffmc double, dmc double, dc double")
        self.waiting = handle.getMapState("waiting", "day long", "t double, h double, wind double, rain double")

    def handleInputRows(self, key, rows, timerValues):
        last = self.now.get()[0] if self.now.exists() else -(10**9)
        for pdf in rows:
            for day, t, h, wind, rain in zip((pd.to_datetime(pdf["ts"]).astype("int64") // (10**6 * _DAY_MS)).tolist(), *(pdf[c].tolist() for c in ("t", "h", "wind", "rain")), strict=True):
                if day > last and not self.waiting.containsKey((day,)):
                    self.waiting.updateValue((day,), (t, h, wind, rain))
                    self.handle.registerTimer((day + 1) * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import datetime

        until = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS
        due = sorted(k[0] for k in self.waiting.keys() if k[0] < until)
        out = []
        last, *codes = self.now.get() if self.now.exists() else (-(10**9), *_BEGIN)
        for day in due:
            date = datetime.date(1970, 1, 1) + datetime.timedelta(days=day)
            if last < (datetime.date(date.year, 1, 1) - datetime.date(1970, 1, 1)).days:
                codes = _BEGIN
            t, h, wind, rain = self.waiting.getValue((day,))
            codes, last = _next(tuple(codes), t, h, wind, rain, date.month), day
            self.waiting.removeKey((day,))
            out.append((key[0], date, wind, *codes))
        if due:
            self.now.update((last, *codes))
            self.handle.registerTimer((last + self.idle) * _DAY_MS)
        elif self.now.exists() and until >= last + self.idle and not any(True for _ in self.waiting.keys()):
            self.now.clear()  # a cell without days for so long is forgotten
        if out:
            yield pd.DataFrame(out, columns=["cell", "day", "wind", "ffmc", "dmc", "dc"])

    def close(self) -> None:
        pass


def ordered_codes(stream: DataFrame, late: str = "3 days", idle: int = 400) -> DataFrame:
    """Codes for a stream of (cell, ts, t, h, wind, rain), one row a day, that may come in any order within ``late``.

    A day is taken when the watermark has passed its end, in the order of days, so
    late days within it give the codes of the batch; later ones are left out, as is
    a day's second row.  State is three numbers and the waiting days of a cell; a
    cell that has been silent for ``idle`` days, more than a year, is forgotten,
    which changes nothing as codes start anew each 1 January.  The query needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    if idle < 366:
        raise ValueError("a cell is kept for a year at least")
    rows = stream.withWatermark("ts", late).groupBy("cell")
    return _closed(rows.transformWithStateInPandas(_Recursion(idle), _CARRIED, "append", "EventTime"))
