"""Canadian fire-weather codes (Van Wagner 1987) as Column expressions, and over arrays.

State is folded over the days of one cell and year; the closing indices have no
state.  All divisions are of doubles that cannot be zero in the physical range.
The formulas are written once: ``F`` is Spark's functions, or ``Arrays`` where a
stream's state lives in Python.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Over-winter start of FFMC, DMC and DC, and monthly day-length factors of DMC and DC.
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
DMC_DAY_LENGTH = [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]
DC_DAY_LENGTH = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library


class _Choice:
    """when / otherwise over arrays."""

    def __init__(self):
        self.conditions, self.values = [], []

    def when(self, condition, value):
        self.conditions.append(condition)
        self.values.append(value)
        return self

    def otherwise(self, value):
        return np.select([np.asarray(c) for c in self.conditions], [np.asarray(v, float) for v in self.values], np.asarray(value, float))


class Arrays:
    """What the formulas use of Spark's functions, for NumPy arrays; values that a choice leaves out may be infinite or undefined."""

    exp, ln, sqrt, pow, least, greatest = np.exp, np.log, np.sqrt, np.power, np.minimum, np.maximum
    lit = staticmethod(np.float64)
    array = staticmethod(lambda *v: np.array(v, float))
    element_at = staticmethod(lambda values, at: values[np.asarray(at, np.int64) - 1])
    try_divide = staticmethod(np.divide)
    when = staticmethod(lambda condition, value: _Choice().when(condition, value))


def _monthly(values: list[float], month: Column, F=F) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), month)


def ffmc_next(ffmc: Column, t: Column, h: Column, wind: Column, rain: Column, F=F) -> Column:
    """Fine fuel moisture code of the day (t in deg C, h in %, wind in km/h, rain in mm)."""
    m0 = 147.2 * (101.0 - ffmc) / (59.5 + ffmc)
    rf = rain - 0.5
    wet = m0 + 42.5 * rf * F.exp(-100.0 / (251.0 - m0)) * (1.0 - F.exp(-6.93 / rf))
    heavy = wet + 0.0015 * (m0 - 150.0) * (m0 - 150.0) * F.sqrt(rf)
    m = F.when(rain > 0.5, F.least(F.when(m0 > 150.0, heavy).otherwise(wet), F.lit(250.0))).otherwise(m0)
    shared = 0.18 * (21.1 - t) * (1.0 - F.exp(-0.115 * h))
    dry_to = 0.942 * F.pow(h, F.lit(0.679)) + 11.0 * F.exp((h - 100.0) / 10.0) + shared
    wet_to = 0.618 * F.pow(h, F.lit(0.753)) + 10.0 * F.exp((h - 100.0) / 10.0) + shared

    def rate(x):
        return (0.424 * (1.0 - F.pow(x, F.lit(1.7))) + 0.0694 * F.sqrt(wind) * (1.0 - F.pow(x, F.lit(8.0)))) * 0.581 * F.exp(0.0365 * t)

    out = F.when(m > dry_to, dry_to + (m - dry_to) * F.pow(F.lit(10.0), -rate(h / 100.0)))
    out = out.when(m < wet_to, wet_to - (wet_to - m) * F.pow(F.lit(10.0), -rate((100.0 - h) / 100.0))).otherwise(m)
    return F.least(F.greatest(59.5 * (250.0 - out) / (147.2 + out), F.lit(0.0)), F.lit(101.0))


def dmc_next(dmc: Column, t: Column, h: Column, rain: Column, month: Column, F=F) -> Column:
    """Duff moisture code of the day."""
    effective = 0.92 * rain - 1.27
    log = F.ln(F.greatest(dmc, F.lit(1.0)))
    b = F.when(dmc <= 33.0, 100.0 / (0.5 + 0.3 * dmc)).when(dmc <= 65.0, 14.0 - 1.3 * log).otherwise(6.2 * log - 17.2)
    moist = 20.0 + F.exp(5.6348 - dmc / 43.43) + 1000.0 * effective / (48.77 + b * effective)
    rained = F.greatest(244.72 - 43.43 * F.ln(F.greatest(moist - 20.0, F.lit(1.0))), F.lit(0.0))
    k = F.when(t < -1.1, 0.0).otherwise(1.894 * (t + 1.1) * (100.0 - h) * _monthly(DMC_DAY_LENGTH, month, F) * 1e-6)
    return F.when(rain > 1.5, rained).otherwise(dmc) + 100.0 * k


def dc_next(dc: Column, t: Column, rain: Column, month: Column, F=F) -> Column:
    """Drought code of the day."""
    moist = 800.0 * F.exp(-dc / 400.0) + 3.937 * (0.83 * rain - 1.27)
    rained = F.greatest(400.0 * F.ln(800.0 / F.greatest(moist, F.lit(1e-6))), F.lit(0.0))
    drying = F.when(t < -2.8, 0.0).otherwise(F.greatest((0.36 * (t + 2.8) + _monthly(DC_DAY_LENGTH, month, F)) / 2.0, F.lit(0.0)))
    return F.when(rain > 2.8, rained).otherwise(dc) + drying


def isi(ffmc: Column, wind: Column, F=F) -> Column:
    m = 147.2 * (101.0 - ffmc) / (59.5 + ffmc)
    return 0.208 * F.exp(0.05039 * wind) * 91.9 * F.exp(-0.1386 * m) * (1.0 + F.pow(m, F.lit(5.31)) / 49300000.0)


def bui(dmc: Column, dc: Column, F=F) -> Column:
    both = dmc + 0.4 * dc
    low = F.try_divide(0.8 * dmc * dc, both)
    high = dmc - (1.0 - F.try_divide(0.8 * dc, both)) * (0.92 + F.pow(0.0114 * dmc, F.lit(1.7)))
    return F.greatest(F.when(dmc <= 0.4 * dc, low).otherwise(high), F.lit(0.0))


def fwi(isi_: Column, bui_: Column, F=F) -> Column:
    duff = F.when(bui_ <= 80.0, 0.626 * F.pow(bui_, F.lit(0.809)) + 2.0).otherwise(1000.0 / (25.0 + 108.64 * F.exp(-0.023 * bui_)))
    b = 0.1 * isi_ * duff
    return F.when(b > 1.0, F.exp(2.72 * F.pow(0.434 * F.ln(b), F.lit(0.647)))).otherwise(F.greatest(b, F.lit(0.0)))


def daily_codes(weather: DataFrame, cell: str = "cell", day: str = "day", stored: str = "float") -> DataFrame:
    """cell, day and the six indices for each row of ``weather`` (cell, day date, t, h, wind, rain).

    State runs over the days of a cell and starts anew each 1 January, so a task
    is a cell and year (at most 366 rows).  The state is double; outputs are
    ``stored`` as floats, as in the original, or as doubles: the indices of strong
    winds are beyond a float.
    """
    row = F.struct(F.col(day).alias("day"), *[F.col(c).cast("double").alias(c) for c in ("t", "h", "wind", "rain")])
    days = weather.groupBy(cell, F.year(day).alias("year")).agg(F.sort_array(F.collect_list(row)).alias("days"))
    empty = F.expr("cast(array() as array<struct<day:date,wind:double,ffmc:double,dmc:double,dc:double>>)")
    start = F.struct(*[F.lit(v).alias(k) for k, v in START.items()], empty.alias("out"))

    def step(s, d):
        month = F.month(d["day"])
        f, p, c = ffmc_next(s["ffmc"], d["t"], d["h"], d["wind"], d["rain"]), dmc_next(s["dmc"], d["t"], d["h"], d["rain"], month), dc_next(s["dc"], d["t"], d["rain"], month)
        new = F.struct(d["day"].alias("day"), d["wind"].alias("wind"), f.alias("ffmc"), p.alias("dmc"), c.alias("dc"))
        return F.struct(f.alias("ffmc"), p.alias("dmc"), c.alias("dc"), F.concat(s["out"], F.array(new)).alias("out"))

    rows = days.select(cell, F.inline(F.aggregate("days", start, step, lambda s: s["out"])))
    i, u = isi(F.col("ffmc"), F.col("wind")), bui(F.col("dmc"), F.col("dc"))
    out = rows.select(cell, F.col("day").alias(day), "ffmc", "dmc", "dc", i.alias("isi"), u.alias("bui"), fwi(i, u).alias("fwi"))
    return out.select(cell, day, *[F.col(c).cast(stored).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")])
