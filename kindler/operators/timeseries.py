"""Season statistics and event windows over long-form grids (cell, ts, values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import circular_std, vpd_hpa, wind_direction, wind_speed


def in_season(df: DataFrame, ts: str = "ts", first: int = 6, last: int = 10) -> DataFrame:
    return df.where(F.month(ts).between(first, last))


def season_stats(daily: DataFrame, cell: list[str], ts: str = "ts", extreme: float = 30.0) -> DataFrame:
    """Mean, interpolated p90 and max of fwi, mean of dc, and extreme days (sum in a year, mean over years; 0 for cells without values)."""
    stats = daily.groupBy(*cell).agg(F.avg("fwi").alias("fwi_season_mean"), F.percentile("fwi", 0.9).alias("fwi_season_p90"), F.max("fwi").alias("fwi_season_max"), F.avg("dc").alias("dc_season_mean"))
    years = daily.groupBy(*cell, F.year(ts).alias("_y")).agg(F.count_if(F.col("fwi") > extreme).alias("_d"))
    days = years.groupBy(*cell).agg(F.avg("_d").alias("fwi_extreme_days"))
    return stats.join(days, cell)


def event_windows(hourly: DataFrame, daily: DataFrame, cell: list[str], event: str) -> DataFrame:
    """Per cell: wind maximum of 24 h, wind-direction consistency of 12 h, VPD maximum of the day, mean DC of the 30 days before, FWI on the date.

    ``hourly`` has ts, u10, v10, t2m, d2m; ``daily`` ts, dc, fwi, whose time of
    day does not matter.  One pass over each; fails if a daily window is empty.
    """
    day = F.to_date(F.lit(event))
    end = day.cast("timestamp") + F.expr("INTERVAL 23 HOURS")
    hours = lambda n: F.col("ts").between(end - F.expr(f"INTERVAL {n} HOURS"), end)
    h = hourly.where(hours(23)).groupBy(*cell).agg(
        F.max(wind_speed("u10", "v10")).alias("wind_speed_max_24h"),
        (1.0 / (circular_std(F.when(hours(11), wind_direction("u10", "v10"))) + 0.01)).alias("wind_dir_consistency"),
        F.max(vpd_hpa("t2m", "d2m")).alias("vpd_event_day"),
    )
    date = F.to_date("ts")
    before, on = date.between(F.date_sub(day, 30), F.date_sub(day, 1)), date == day
    near = daily.where(before | on)
    have = near.agg(F.count_if(before).alias("a"), F.count_if(on).alias("b")).first()
    if not have["a"] or not have["b"]:
        raise ValueError(f"no daily values in the 30 days before {event} or on it")
    d = near.groupBy(*cell).agg(F.avg(F.when(before, F.col("dc"))).alias("dc_antecedent_30d"), F.max(F.when(on, F.col("fwi"))).alias("fwi_event_day"))
    return h.join(d, cell)


def grid_rows(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """All cells of two axes (latitude), (longitude)."""
    return lats.crossJoin(lons)


def regrid_nearest(values: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` (latitude, longitude) with ``columns`` of the nearest grid point of ``values``; outside its extent null.

    Nearest values are found for each axis on its own, by the nearest-neighbour
    join along a line (ties: the smaller value), then joined.
    """
    from .spatial import nearest

    out = target
    for axis in ("latitude", "longitude"):
        src = values.where(F.col(axis).isNotNull()).select(F.col(axis).alias("s"), F.col(axis).alias("rx"), F.lit(0.0).alias("ry")).distinct()
        lo, hi = src.agg(F.min("s"), F.max("s")).first()
        dst = target.where(F.col(axis).between(lo, hi) if lo is not None else F.lit(False)).select(F.col(axis).alias("d"), F.col(axis).alias("x"), F.lit(0.0).alias("y")).distinct()
        near = nearest(dst, src, "d", "s").select(F.col("d").alias(axis), F.col("near.s").alias(f"_{axis}"))
        out = out.join(near, axis, "left")
    src = values.select(F.col("latitude").alias("_latitude"), F.col("longitude").alias("_longitude"), *columns)
    return out.join(src, ["_latitude", "_longitude"], "left").select(*target.columns, *columns)
