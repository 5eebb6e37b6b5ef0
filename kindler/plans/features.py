"""Weather features: season statistics, event windows and fire-weather codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fire_weather as W
from ..operators import timeseries as TS
from .core import r6
from .tables import registry, with_views

Q, SQL, query = registry()


@query(with_views("wx") + ", d AS (SELECT cell, avg(fwi) AS m, quantile_cont(fwi, 0.9) AS p, max(fwi) AS x, avg(dc) AS dc FROM wx GROUP BY 1), y AS (SELECT cell, avg(n) AS n FROM (SELECT cell, year(ts) AS y, count(*) FILTER (WHERE fwi > 30) AS n FROM wx GROUP BY 1, 2) GROUP BY 1) SELECT d.cell, round(m, 6) AS fwi_season_mean, round(p, 6) AS fwi_season_p90, round(x, 6) AS fwi_season_max, round(dc, 6) AS dc_season_mean, round(n, 6) AS fwi_extreme_days FROM d JOIN y USING (cell)")
def ag8_ag9_season_stats(t):
    d = TS.season_stats(t("wx"), ["cell"])
    return d.select("cell", *[r6(c, c) for c in ("fwi_season_mean", "fwi_season_p90", "fwi_season_max", "dc_season_mean", "fwi_extreme_days")])


_VPD = "greatest(6.112*exp(17.67*(t2m-273.15)/(t2m-273.15+243.5)) - 6.112*exp(17.67*(d2m-273.15)/(d2m-273.15+243.5)), 0)"
_H12 = "FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 23:00:00')"


def _r(filter_):
    return f"sqrt(avg(sin(atan2(v10, u10))) {filter_} * avg(sin(atan2(v10, u10))) {filter_} + avg(cos(atan2(v10, u10))) {filter_} * avg(cos(atan2(v10, u10))) {filter_})"


@query(with_views("wx") + f", h AS (SELECT cell, max(sqrt(u10*u10+v10*v10)) AS w, 1.0 / (sqrt(-2 * ln(least(greatest({_r(_H12)}, 1e-10), 1.0))) + 0.01) AS c, max({_VPD}) AS p FROM wx WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 23:00:00' GROUP BY 1), d AS (SELECT cell, avg(dc) FILTER (WHERE CAST(ts AS DATE) < DATE '2024-01-15') AS dc, max(fwi) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS f FROM wx WHERE CAST(ts AS DATE) BETWEEN DATE '2023-12-16' AND DATE '2024-01-15' GROUP BY 1) SELECT cell, round(w, 6) AS wind_speed_max_24h, round(c, 2) AS wind_dir_consistency, round(p, 6) AS vpd_event_day, round(dc, 6) AS dc_antecedent_30d, round(f, 6) AS fwi_event_day FROM h JOIN d USING (cell)")
def ag10_ag11_event_windows(t):
    d = TS.event_windows(t("wx"), t("wx"), ["cell"], "2024-01-15")
    return d.select("cell", r6("wind_speed_max_24h", "wind_speed_max_24h"), F.round("wind_dir_consistency", 2).alias("wind_dir_consistency"), *[r6(c, c) for c in ("vpd_event_day", "dc_antecedent_30d", "fwi_event_day")])


@query(with_views("wx") + f" SELECT cell, round(sqrt(-2 * ln(least(greatest({_r('')}, 1e-10), 1.0))), 6) AS s FROM wx GROUP BY 1")
def ag11_circular_std(t):
    from ..functions.scalars import circular_std, wind_direction

    return t("wx").groupBy("cell").agg(r6(circular_std(wind_direction("u10", "v10")), "s"))


_DAYS = "SELECT CAST(user_id % 24 AS BIGINT) AS cell, CAST(ts AS DATE) AS day, 5.0 + avg(value) / 15.0 AS t, 30.0 + avg(value) / 10.0 AS h, 4.0 + count(*) AS wind, CASE WHEN count(*) % 4 = 0 THEN CAST(count(*) AS DOUBLE) / 2.0 ELSE 0.0 END AS rain FROM events GROUP BY 1, 2"

_M0 = "(147.2 * (101.0 - f.ffmc) / (59.5 + f.ffmc))"
_SHARED = "0.18 * (21.1 - t) * (1.0 - exp(-0.115 * h))"
_LE = "[6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0][month(day)]"
_LF = "[-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6][month(day)]"
_RATE = "((0.424 * (1.0 - pow({x}, 1.7)) + 0.0694 * sqrt(wind) * (1.0 - pow({x}, 8.0))) * 0.581 * exp(0.0365 * t))"

_FWI = f"""
WITH RECURSIVE raw AS ({_DAYS}),
d AS (SELECT cell, day, CAST(t AS DOUBLE) AS t, CAST(h AS DOUBLE) AS h, CAST(wind AS DOUBLE) AS wind, CAST(rain AS DOUBLE) AS rain, row_number() OVER (PARTITION BY cell, year(day) ORDER BY day) AS k, year(day) AS y FROM raw),
f(cell, y, k, day, wind, ffmc, dmc, dc) AS (
  SELECT DISTINCT cell, y, CAST(0 AS BIGINT), CAST(NULL AS DATE), CAST(0 AS DOUBLE), CAST(85 AS DOUBLE), CAST(6 AS DOUBLE), CAST(15 AS DOUBLE) FROM d
  UNION ALL
  SELECT cell, y, k, day, wind,
    least(greatest(59.5 * (250.0 - mo) / (147.2 + mo), 0.0), 101.0),
    CASE WHEN rain > 1.5 THEN greatest(244.72 - 43.43 * ln(greatest(20.0 + exp(5.6348 - dmc0 / 43.43) + 1000.0 * re / (48.77 + b * re) - 20.0, 1.0)), 0.0) ELSE dmc0 END
      + 100.0 * CASE WHEN t < -1.1 THEN 0.0 ELSE 1.894 * (t + 1.1) * (100.0 - h) * {_LE} * 1e-6 END,
    CASE WHEN rain > 2.8 THEN greatest(400.0 * ln(800.0 / greatest(800.0 * exp(-dc0 / 400.0) + 3.937 * (0.83 * rain - 1.27), 1e-6)), 0.0) ELSE dc0 END
      + CASE WHEN t < -2.8 THEN 0.0 ELSE greatest((0.36 * (t + 2.8) + {_LF}) / 2.0, 0.0) END
  FROM (SELECT *, CASE WHEN m > ed THEN ed + (m - ed) * pow(10.0, -{_RATE.format(x='(h / 100.0)')}) WHEN m < ew THEN ew - (ew - m) * pow(10.0, -{_RATE.format(x='((100.0 - h) / 100.0)')}) ELSE m END AS mo
    FROM (SELECT f.cell, f.y, d.k, d.day, d.wind, d.t, d.h, d.rain, f.dmc AS dmc0, f.dc AS dc0, 0.92 * d.rain - 1.27 AS re,
      CASE WHEN f.dmc <= 33.0 THEN 100.0 / (0.5 + 0.3 * f.dmc) WHEN f.dmc <= 65.0 THEN 14.0 - 1.3 * ln(greatest(f.dmc, 1.0)) ELSE 6.2 * ln(greatest(f.dmc, 1.0)) - 17.2 END AS b,
      CASE WHEN d.rain > 0.5 THEN least({_M0} + CASE WHEN {_M0} > 150.0 THEN 0.0015 * ({_M0} - 150.0) * ({_M0} - 150.0) * sqrt(d.rain - 0.5) ELSE 0.0 END + 42.5 * (d.rain - 0.5) * exp(-100.0 / (251.0 - {_M0})) * (1.0 - exp(-6.93 / (d.rain - 0.5))), 250.0) ELSE {_M0} END AS m,
      0.942 * pow(h, 0.679) + 11.0 * exp((h - 100.0) / 10.0) + {_SHARED} AS ed, 0.618 * pow(h, 0.753) + 10.0 * exp((h - 100.0) / 10.0) + {_SHARED} AS ew
      FROM f JOIN d ON d.cell = f.cell AND d.y = f.y AND d.k = f.k + 1))),
i AS (SELECT *, 147.2 * (101.0 - ffmc) / (59.5 + ffmc) AS m FROM f WHERE k > 0),
j AS (SELECT *, 0.208 * exp(0.05039 * wind) * 91.9 * exp(-0.1386 * m) * (1.0 + pow(m, 5.31) / 49300000.0) AS isi,
  greatest(CASE WHEN dmc <= 0.4 * dc THEN 0.8 * dmc * dc / (dmc + 0.4 * dc) ELSE dmc - (1.0 - 0.8 * dc / (dmc + 0.4 * dc)) * (0.92 + pow(0.0114 * dmc, 1.7)) END, 0.0) AS bui FROM i),
b AS (SELECT *, 0.1 * isi * CASE WHEN bui <= 80.0 THEN 0.626 * pow(bui, 0.809) + 2.0 ELSE 1000.0 / (25.0 + 108.64 * exp(-0.023 * bui)) END AS b FROM j)
SELECT cell, day, round(ffmc, 2) AS ffmc, round(dmc, 2) AS dmc, round(dc, 2) AS dc, round(isi, 2) AS isi, round(bui, 2) AS bui, round(CASE WHEN b > 1.0 THEN exp(2.72 * pow(0.434 * ln(b), 0.647)) ELSE greatest(b, 0.0) END, 2) AS fwi FROM b"""


@query(_FWI)
def ts2_ts3_ts4_ts5_fire_weather(t):
    codes = W.daily_codes(t.sql(_DAYS), stored="double")
    return codes.select("cell", "day", *[F.round(c, 2).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")])
