"""Nearest, radius, containment and raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import perimeters, raster, repair, spatial
from ..session import spread
from .core import r6
from .tables import PIX, registry, with_views

Q, SQL, query = registry()


@query(with_views("bld", "cells") + " SELECT id, cid, round(v, 6) AS v FROM (SELECT id, cid, v, row_number() OVER (PARTITION BY id ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy), cid) AS rn FROM bld, cells WHERE v IS NOT NULL) WHERE rn = 1")
def j8_nearest_cell(t):
    cells = t("cells").where("v is not null")
    d = spatial.nearest(t("bld"), cells, "id", "cid", rx="cx", ry="cy")
    return d.select("id", F.col("near.cid").alias("cid"), r6(F.col("near.v"), "v"))


@query(with_views("bld", "hot") + " SELECT id, arg_min(hid, ((x-hx)*(x-hx)+(y-hy)*(y-hy), hid)) AS hid FROM bld, hot GROUP BY id")
def j8_nearest_by_grid(t):
    """The same join with the grid search, as for sides too large to broadcast."""
    d = spatial.nearest(t("bld"), t("hot"), "id", "hid", rx="hx", ry="hy", cell=2500.0)
    return d.select("id", F.col("near.hid").alias("hid"))


@query(with_views("bld") + " SELECT a.id, count(b.id) AS neighbours, round(count(b.id) / (pi() * 4.0), 6) AS per_km2 FROM bld a LEFT JOIN bld b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 4000000.0 GROUP BY 1")
def j9_radius_self_count(t):
    b = t("bld")
    d = spatial.radius_count(b, b.select(F.col("id").alias("oid"), F.col("x").alias("rx"), F.col("y").alias("ry")), 2000.0, "id", "neighbours", other="oid")
    return d.select("id", "neighbours", r6(F.col("neighbours") / (F.pi() * 4.0), "per_km2"))


@query(with_views("bld", "hot") + " SELECT id, count(hid) AS firms_hotspot_count_5km FROM bld LEFT JOIN hot ON (x-hx)*(x-hx)+(y-hy)*(y-hy) <= 25000000.0 GROUP BY 1")
def j10_radius_count(t):
    d = spatial.radius_count(t("bld"), t("hot"), 5000.0, "id", "firms_hotspot_count_5km", rx="hx", ry="hy")
    return d.select("id", "firms_hotspot_count_5km")


@query(with_views("bld", "fires") + " SELECT id, round(min(abs(sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) - r)), 6) AS dist_to_nearest_fire_m, count(*) FILTER (WHERE greatest(sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) - r, 0) < 5000) AS fire_count_5km, count(*) FILTER (WHERE greatest(sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) - r, 0) < 10000) AS fire_count_10km, CAST(max((sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) < r)::INT) AS INTEGER) AS ever_burned, round(sum(CASE WHEN greatest(sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) - r, 0) < 10000 THEN 1.0::DOUBLE / (2024 - yr + 1) ELSE 0 END), 6) AS recency_score FROM bld, fires GROUP BY 1")
def j11_ag12_ag13_ag14_fire_history(t):
    d = spatial.circle_features(t("bld"), t("fires"), "id", 2024)
    return d.select("id", r6("dist_to_nearest_fire_m", "dist_to_nearest_fire_m"), "fire_count_5km", "fire_count_10km", "ever_burned", r6("recency_score", "recency_score"))


def _boxes(t):
    corner = lambda a, b: F.struct((F.col("fx") + a * F.col("r")).alias("x"), (F.col("fy") + b * F.col("r")).alias("y"))
    return t("fires").select("fid", F.array(corner(-4, -4), corner(4, -4), corner(4, 4), corner(-4, 4)).alias("ring"))


@query(with_views("bld", "fires") + " SELECT id, CAST(max((x > fx-4*r AND x < fx+4*r AND y > fy-4*r AND y < fy+4*r)::INT) AS INTEGER) AS burned FROM bld, fires GROUP BY 1")
def j12_j13_inside_polygons(t):
    return spatial.label_inside(t("bld"), _boxes(t), "id", "fid")


@query(with_views("bld", more=PIX) + " SELECT id, p.v FROM bld LEFT JOIN pix p ON p.row = CAST(floor((78000.0 - y) / 390.0) AS BIGINT) AND p.col = CAST(floor((x - 5000.0) / 390.0) AS BIGINT)")
def j14_raster_sample(t):
    return spatial.sample_raster(t("bld"), t.pixels(), 5000.0, 78000.0, 390.0, 200, 50).select("id", "v")


@query(with_views("bld", more=PIX) + " SELECT id, p.v FROM bld LEFT JOIN pix p ON p.row = least(greatest(CAST(floor((78000.0 - y) / 390.0) AS BIGINT), 0), 199) AND p.col = least(greatest(CAST(floor((x - 5000.0) / 390.0) AS BIGINT), 0), 49)")
def j14_raster_sample_clamped(t):
    return spatial.sample_raster(t("bld"), t.pixels(), 5000.0, 78000.0, 390.0, 200, 50, clamp=True).select("id", "v")


_GRID = """WITH la AS (SELECT DISTINCT 37.0::DOUBLE + p_partkey % 40 * 0.1::DOUBLE AS la, p_partkey % 40 AS i FROM part), lo AS (SELECT DISTINCT 23.0::DOUBLE + p_partkey // 40 * 0.1::DOUBLE AS lo, p_partkey // 40 AS j FROM part),
s AS (SELECT la, lo, p_retailprice AS dc FROM la, lo LEFT JOIN part ON p_partkey = j * 40 + i),
ga AS (SELECT DISTINCT round(36.96::DOUBLE + s_suppkey % 60 * 0.07::DOUBLE, 4) AS latitude FROM supplier), go AS (SELECT DISTINCT round(22.97::DOUBLE + s_suppkey % 45 * 0.11::DOUBLE, 4) AS longitude FROM supplier),
na AS (SELECT latitude, arg_min(la, (abs(la - latitude), la)) AS la FROM ga, la GROUP BY 1 HAVING latitude BETWEEN min(la) AND max(la)), no AS (SELECT longitude, arg_min(lo, (abs(lo - longitude), lo)) AS lo FROM go, lo GROUP BY 1 HAVING longitude BETWEEN min(lo) AND max(lo))
SELECT ga.latitude, go.longitude, s.dc FROM ga CROSS JOIN go LEFT JOIN na ON na.latitude = ga.latitude LEFT JOIN no ON no.longitude = go.longitude LEFT JOIN s ON s.la = na.la AND s.lo = no.lo"""


@query(_GRID)
def j15_ts1_regrid(t):
    """A grid of the parts on the axes of another one, taken from the suppliers."""
    from ..operators.timeseries import grid_rows, regrid_nearest

    axis = lambda df, k, a, step, name: df.select(k.alias(f"i_{name}")).distinct().select((a + F.col(f"i_{name}") * step).alias(name), f"i_{name}")
    part, at = t("part"), F.col("p_partkey")
    i, j = at % 40, F.floor(at / 40)
    src = grid_rows(axis(part, i, 37.0, 0.1, "latitude"), axis(part, j, 23.0, 0.1, "longitude"))
    src = src.join(part.select(i.alias("i_latitude"), j.alias("i_longitude"), F.col("p_retailprice").alias("dc")), ["i_latitude", "i_longitude"], "left").select("latitude", "longitude", "dc")
    place = lambda k, a, step, name: t("supplier").select(F.round(a + k * step, 4).alias(name)).distinct()
    dst = grid_rows(place(F.col("s_suppkey") % 60, 36.96, 0.07, "latitude"), place(F.col("s_suppkey") % 45, 22.97, 0.11, "longitude"))
    return regrid_nearest(src, dst, ["dc"])


@query(with_views("fires") + " SELECT fid, round(64.0 * r * r, 6) AS area, round(fx, 6) AS cx, round(fy, 6) AS cy, CAST(4 AS INTEGER) AS points FROM fires")
def geo3_geo5_area_centroid_wkt(t):
    """Rings go through WKT and back before they are measured."""
    back = _boxes(t).withColumn("ring", G.from_wkt(G.to_wkt(F.col("ring"))))
    c = G.ring_centroid(F.col("ring"))
    return back.select("fid", r6(G.ring_area(F.col("ring")), "area"), r6(c["x"], "cx"), r6(c["y"], "cy"), F.size("ring").alias("points"))


@query(with_views("fires") + " SELECT fid, round(128.0 * r * r * sin(2 * pi() / 256), 4) AS area, CAST(256 AS INTEGER) AS points FROM fires")
def geo4_circles(t):
    ring = G.circle_ring(F.col("fx"), F.col("fy"), F.col("r"))
    return t("fires").select("fid", F.round(G.ring_area(ring), 4).alias("area"), F.size(ring).alias("points"))


#: Rings of a perimeter, as multiples of its size from its centre: a part with a hole, and a second part.
PARTS = [[[(4.0, 0.0), (2.0, 2.0), (0.0, 4.0), (-1.0, 1.0), (-4.0, 0.0), (-2.0, -3.0), (0.0, -4.0), (3.0, -3.0)], [(0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5)]], [[(6.0, 0.0), (8.0, 1.0), (7.0, 4.0)]]]


def _perimeters(t):
    point = lambda p: F.struct((F.col("cx") + p[0] * F.col("r")).alias("x"), (F.col("cy") + p[1] * F.col("r")).alias("y"))
    parts = F.array(*[F.array(*[F.array(*map(point, ring)) for ring in part]) for part in PARTS])
    return t("per").select("pid", "yr", parts.alias("parts"))


def _edges_sql() -> str:
    """(pid, yr, part, outer_ring, x1, y1, x2, y2) of every edge, as a common table expression."""
    rows = [(p, r == 0, *a, *b) for p, part in enumerate(PARTS) for r, ring in enumerate(part) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    values = ", ".join(f"({p}, {o}, {', '.join(f'({v!r})::DOUBLE' for v in at)})" for p, o, *at in rows)
    return f"k(part, outer_ring, ax, ay, zx, zy) AS (VALUES {values}), e AS (SELECT pid, yr, part, outer_ring, cx + ax * r AS x1, cy + ay * r AS y1, cx + zx * r AS x2, cy + zy * r AS y2 FROM per, k)"


#: Every building against every edge.
_MEASURED = with_views("bld", "per") + ", " + _edges_sql() + """,
m AS (SELECT id, x, y, pid, yr, part, outer_ring, x1, y1, x2, y2, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS s FROM bld, e),
d AS (SELECT *, sqrt((x - x1 - s * (x2 - x1)) * (x - x1 - s * (x2 - x1)) + (y - y1 - s * (y2 - y1)) * (y - y1 - s * (y2 - y1))) AS d,
  (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END + x1 AS crosses,
  (x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AS touches FROM m),
g AS (SELECT id, pid, any_value(yr) AS yr, part, min(d) AS d, min(d) FILTER (WHERE outer_ring) AS edge, count(*) FILTER (WHERE crosses) % 2 = 1 AND NOT bool_or(touches) AS within FROM d GROUP BY id, pid, part),
h AS (SELECT id, pid, any_value(yr) AS yr, min(edge) AS edge, bool_or(within) AS within, CASE WHEN bool_or(within) THEN 0 ELSE min(d) END AS d FROM g GROUP BY id, pid)"""


@query(_MEASURED + " SELECT id, round(min(edge), 6) AS dist_to_nearest_fire_m, arg_min(pid, (edge, pid)) AS nearest_fire, count(*) FILTER (WHERE d < 5000) AS fire_count_5km, count(*) FILTER (WHERE d < 10000) AS fire_count_10km, CAST(max(within::INT) AS INTEGER) AS ever_burned, round(sum(CASE WHEN d < 10000 THEN 1.0::DOUBLE / (2024 - yr + 1) ELSE 0 END), 6) AS recency_score FROM h GROUP BY id")
def j11_ag12_ag13_ag14_perimeters(t):
    """The fire history by polygons of two parts, one with a hole."""
    d = perimeters.perimeter_features(t("bld"), _perimeters(t), "id", 2024)
    return d.select("id", r6("dist_to_nearest_fire_m", "dist_to_nearest_fire_m"), "nearest_fire", "fire_count_5km", "fire_count_10km", "ever_burned", r6("recency_score", "recency_score"))


@query(_MEASURED + " SELECT id, arg_min(pid, (edge, pid)) AS pid, round(min(edge), 4) AS dist FROM h GROUP BY id")
def geo6_boundary_distance(t):
    """The nearest perimeter of each building and the distance to its outer rings."""
    d = perimeters.nearest_boundary(t("bld"), _perimeters(t), "id")
    return d.select("id", "pid", F.round("dist", 4).alias("dist"))


#: Footprints of the parts: plain rings, two lobes that cross, a loop that touches a corner, a spike, and rings without area.
_FOOTPRINT = "SELECT p_partkey AS id, p_partkey % 5 AS kind, CAST(p_partkey * 37 % 8000 AS DOUBLE) AS u, CAST(p_partkey * 53 % 7000 AS DOUBLE) AS w, CAST(2 + p_size % 9 AS DOUBLE) AS a, CAST(3 + p_partkey % 11 AS DOUBLE) AS b, CAST(1 + p_size % 7 AS DOUBLE) AS c FROM part"


@query(f"WITH f AS ({_FOOTPRINT})" + """, s AS (SELECT *, CASE kind WHEN 0 THEN a * b WHEN 1 THEN greatest(b * (a - a * c / (b + c)) / 2, c * (a * c / (b + c)) / 2)
  WHEN 2 THEN 16 * a * a - 1.5 * a * a WHEN 3 THEN a * b ELSE 0 END AS area FROM f)
SELECT id, round(area, 6) AS area, CAST(CASE kind WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS n_rings, kind IN (1, 2, 3) AS repaired FROM s WHERE area >= 5""")
def geo2_repaired_footprints(t):
    """GEO2 and PF8: rings are made valid, the largest part stays, small and collapsed ones go."""
    at = lambda x, y: F.struct((F.col("u") + x).alias("x"), (F.col("w") + y).alias("y"))
    a, b, c, o = F.col("a"), F.col("b"), F.col("c"), F.lit(0.0)
    box = [at(o, o), at(a, o), at(a, b), at(o, b)]
    lobes = [at(o, o), at(a, b), at(a, o), at(o, c)]
    loop = [at(o, o), at(4 * a, o), at(4 * a, 4 * a), at(o, 4 * a), at(o, o), at(a, 2 * a), at(2 * a, a)]
    spike = [at(o, o), at(a, o), at(a, b), at(3 * a, 2 * b), at(a, b), at(o, b), at(o, o)]
    flat = [at(o, o), at(a, b), at(2 * a, 2 * b), at(o, o)]
    shapes = [F.array(*ring) for ring in (box, lobes, loop, spike, flat)]
    ring = F.when(F.col("kind") == 0, shapes[0])
    for k in range(1, 5):
        ring = ring.when(F.col("kind") == k, shapes[k])
    made = repair.repaired(t.sql(_FOOTPRINT).select("id", ring.alias("ring")), "id").where("area >= 5")
    return made.select("id", r6("area", "area"), F.size("rings").alias("n_rings"), "repaired")


def _project_sql() -> str:
    """The datum shift and Krueger's series over known fires, step by step."""
    from ..sources.requests import KNOWN_FIRES

    f = 1 / G.INV_F
    e2, n = f * (2 - f), f / (2 - f)
    b, e = G.A * (1 - f), (f * (2 - f)) ** 0.5
    scale = G.K0 * G.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    d = lambda v: f"({v!r})::DOUBLE"
    rows = ", ".join(f"('EFFIS_{day.replace('-', '')}_{i:03d}', {day[:4]}, '{region}', {d(lon)}, {d(lat)}, {d(area)})" for i, (day, region, lon, lat, area, _) in enumerate(KNOWN_FIRES, 1))
    east = " + ".join(["eta", *(f"{d(a)} * cos({2 * k} * xi) * (exp({2 * k} * eta) - exp(-{2 * k} * eta)) / 2" for k, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{d(a)} * sin({2 * k} * xi) * (exp({2 * k} * eta) + exp(-{2 * k} * eta)) / 2" for k, a in enumerate(alpha, 1))])
    atanh = lambda v: f"(0.5 * ln((1 + {v}) / (1 - {v})))"
    return (
        f"WITH known(fire_id, year, region, lon, lat, area) AS (VALUES {rows}), k AS (SELECT * FROM known UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), CAST(2000 + s_suppkey % 25 AS INTEGER), s_name, 20 + (s_suppkey*37 % 8000) / 1000::DOUBLE, 35 + (s_suppkey*53 % 6000) / 1000::DOUBLE, CAST(1 + s_suppkey % 50 AS DOUBLE) FROM supplier), r AS (SELECT *, radians(lon) AS l0, radians(lat) AS p0 FROM k), "
        f"g AS (SELECT *, {d(G.A)} / sqrt(1 - {d(e2)} * sin(p0) * sin(p0)) AS nu FROM r), "
        f"c AS (SELECT *, nu * cos(p0) * cos(l0) - {d(G.SHIFT[0])} AS cx, nu * cos(p0) * sin(l0) - {d(G.SHIFT[1])} AS cy, nu * {d(1 - e2)} * sin(p0) - {d(G.SHIFT[2])} AS cz FROM g), "
        f"h AS (SELECT *, sqrt(cx * cx + cy * cy) AS p, atan2(cz * {d(G.A)}, sqrt(cx * cx + cy * cy) * {d(b)}) AS th FROM c), "
        f"m AS (SELECT *, atan2(cy, cx) - radians({d(G.LON0)}) AS d, atan2(cz + {d(e2 / (1 - e2) * b)} * sin(th) ** 3, p - {d(e2 * G.A)} * cos(th) ** 3) AS phi FROM h), "
        f"u AS (SELECT *, {atanh('sin(phi)')} - {d(e)} * {atanh(f'({d(e)} * sin(phi))')} AS psi FROM m), "
        "t AS (SELECT *, (exp(psi) - exp(-psi)) / 2 AS tau FROM u), "
        f"v AS (SELECT *, atan2(tau, cos(d)) AS xi, {atanh('(sin(d) / sqrt(1 + tau * tau))')} AS eta FROM t) "
        f"SELECT fire_id, CAST(year AS INTEGER) AS year, region, round(area, 2) AS area_km2, round(sqrt(area * 1000000 / pi()), 6) AS radius_m, round({d(G.FE)} + {d(scale)} * ({east}), 2) AS x, round({d(G.FN)} + {d(scale)} * ({north}), 2) AS y FROM v"
    )


@query(_project_sql())
def geo1_project_known_fires(t):
    """WGS84 to the Greek grid, for the known fires and a place for each supplier; held against published control values in the tests."""
    from ..functions.scalars import circle_radius_m
    from ..sources.requests import known_fires

    k, area = F.col("s_suppkey"), (1 + F.col("s_suppkey") % 50).cast("double")
    places = t("supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("fire_id"), (2000 + k % 25).cast("int").alias("year"), F.col("s_name").alias("region"),
        (20 + (k * 37 % 8000) / 1000).alias("lon"), (35 + (k * 53 % 6000) / 1000).alias("lat"), area.alias("area_km2"), circle_radius_m(area).alias("radius_m"),
    )
    every = known_fires(t.spark).select(*places.columns).unionByName(places)
    p = G.project(F.col("lon"), F.col("lat"))
    return every.select("fire_id", "year", "region", F.round("area_km2", 2).alias("area_km2"), r6("radius_m", "radius_m"), F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"))


@query("WITH " + PIX + ", t AS (SELECT row, col, v, 1 AS pri FROM pix WHERE col < 30 UNION ALL SELECT row, col, v + 1000, 2 FROM pix WHERE col >= 20) SELECT row, col, max_by(v, pri) AS v FROM t WHERE row >= 5 AND col BETWEEN 4 AND 45 GROUP BY 1, 2")
def ras1_mosaic(t):
    p = t.pixels()
    tiles = p.where("col < 30").withColumn("pri", F.lit(1)).unionByName(p.where("col >= 20").select("row", "col", (F.col("v") + 1000).alias("v"), F.lit(2).alias("pri")))
    return raster.mosaic(tiles, "pri", (5, 1 << 40, 4, 45))


_TARGET = ", t AS (SELECT trow, tcol, trow * 0.75::DOUBLE AS y, tcol * 0.5::DOUBLE AS x FROM (SELECT p_partkey AS trow, unnest(range(99)) AS tcol FROM part))"


def _target(t):
    return spread(t.sql("SELECT p_partkey AS trow FROM part")).selectExpr("trow", "explode(sequence(0L, 98L)) AS tcol").selectExpr("trow", "tcol", "trow * 0.75D AS y", "tcol * 0.5D AS x")


@query("WITH " + PIX + _TARGET + " SELECT trow, tcol, v FROM t LEFT JOIN pix ON row = CAST(floor(y + 0.5) AS BIGINT) AND col = CAST(floor(x + 0.5) AS BIGINT)")
def ras2_resample_nearest(t):
    return raster.resample(t.pixels(), _target(t))


@query("WITH " + PIX + _TARGET + ", k AS (SELECT trow, tcol, CAST(floor(y) AS BIGINT) + a.range AS row, CAST(floor(x) AS BIGINT) + b.range AS col, (CASE WHEN a.range = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b.range = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM t, range(2) a, range(2) b) SELECT trow, tcol, CASE WHEN count(v) = count(*) THEN round(sum(w * v), 6) END AS v FROM k LEFT JOIN pix USING (row, col) WHERE w > 0 GROUP BY 1, 2")
def ras2_resample_bilinear(t):
    d = raster.resample(t.pixels(), _target(t), "bilinear")
    return d.select("trow", "tcol", r6("v", "v"))


_HORN = "WITH " + PIX + """, we AS (SELECT p.row, p.col, p.v, coalesce(l.v, p.v) AS w, coalesce(r.v, p.v) AS e FROM pix p LEFT JOIN pix l ON l.row = p.row AND l.col = p.col - 1 LEFT JOIN pix r ON r.row = p.row AND r.col = p.col + 1),
ns AS (SELECT c.row, c.col, c.w, c.v, c.e, coalesce(n.w, c.w) AS nw, coalesce(n.v, c.v) AS nv, coalesce(n.e, c.e) AS ne, coalesce(s.w, c.w) AS sw, coalesce(s.v, c.v) AS sv, coalesce(s.e, c.e) AS se
  FROM we c LEFT JOIN we n ON n.row = c.row - 1 AND n.col = c.col LEFT JOIN we s ON s.row = c.row + 1 AND s.col = c.col),
w AS (SELECT row, col, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240.0 AS dx, ((sw + 2 * sv + se) - (nw + 2 * nv + ne)) / 240.0 AS dy FROM ns)
SELECT row, col, round(degrees(atan(sqrt(dx*dx + dy*dy))), 6) AS slope_deg, round(CASE WHEN dx = 0 AND dy = 0 THEN 270.0 ELSE 450.0 - degrees(atan2(dy, -dx)) - 360.0 * floor((450.0 - degrees(atan2(dy, -dx))) / 360.0) END, 6) AS aspect_deg FROM w"""


@query(_HORN)
def w6_ras3_slope_aspect(t):
    d = raster.slope_aspect(t.pixels(), 30.0)
    return d.select("row", "col", r6("slope_deg", "slope_deg"), r6("aspect_deg", "aspect_deg"))


def _mirror(x, n):
    return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"


_FOCAL = "WITH " + PIX + ", k AS MATERIALIZED (SELECT p.row, p.col, " + _mirror("p.row + a.range - 3", "h") + " AS qr, " + _mirror("p.col + b.range - 3", "50") + " AS qc FROM pix p, lines, range(7) a, range(7) b), f AS (SELECT k.row, k.col, avg(q.v) AS m, avg(q.v * q.v) AS m2, avg((q.v % 2)) AS share FROM k JOIN pix q ON q.row = qr AND q.col = qc GROUP BY 1, 2)"


@query(_FOCAL + " SELECT row, col, round(m, 6) AS m, round(v - m, 6) AS tpi, round(sqrt(greatest(0, m2 - 2 * v * m + v * v)), 4) AS tri FROM f JOIN pix USING (row, col)")
def ras4_ras5_ras6_focal(t):
    p = t.pixels()
    d = raster.position_ruggedness(p, 3, t.lines(), 50)
    return d.select("row", "col", r6("m", "m"), r6("tpi", "tpi"), F.round("tri", 4).alias("tri"))


@query(_FOCAL + " SELECT row, col, round(share, 6) AS m FROM f")
def ras7_vegetation_fraction(t):
    p = t.pixels().withColumn("v", F.col("v") % 2)
    return raster.fraction(p, 3, t.lines(), 50).select("row", "col", r6("m", "m"))


@query("WITH " + PIX + ", pts AS (SELECT p_partkey AS id, p_partkey * 7 % 200 AS row, p_partkey * 11 % 50 AS col FROM part) SELECT id, round(min(sqrt(((t.row - q.row) * 30.0) * ((t.row - q.row) * 30.0) + ((t.col - q.col) * 20.0) * ((t.col - q.col) * 20.0))), 6) AS dist FROM pts t, pix q WHERE q.v = 5 GROUP BY 1")
def ras8_class_distance(t):
    pts = t("part").selectExpr("p_partkey AS id", "p_partkey * 7 % 200 AS row", "p_partkey * 11 % 50 AS col")
    return raster.class_distance(pts, t.pixels(), 5, "id", 30.0, 20.0).select("id", r6("dist", "dist"))


#: Vegetation in patches that roads along lines and columns keep small, as the oracle follows every path.
_GREEN = "(row * 13 + col * 7 + row * col) % 5 < 3 AND row % 6 <> 0 AND col % 10 <> 0"


def _vegetation(t):
    return t.pixels().selectExpr("row", "col", f"CAST({_GREEN} AS INT) AS v")


#: Labels by minima that spread until nothing changes.
_COMPONENTS = "WITH RECURSIVE " + PIX + f""", veg AS (SELECT row, col, row * 50 + col AS id FROM pix WHERE {_GREEN}),
steps AS (SELECT u.id AS a, v.id AS b FROM veg u JOIN veg v ON v.row = u.row AND v.col = u.col + 1 UNION ALL SELECT u.id, v.id FROM veg u JOIN veg v ON v.row = u.row + 1 AND v.col = u.col),
pairs AS (SELECT a, b FROM steps UNION ALL SELECT b, a FROM steps),
reach(id, low) AS (SELECT id, id FROM veg UNION SELECT s.b, r.low FROM reach r JOIN pairs s ON s.a = r.id),
lab AS (SELECT id, min(low) AS label FROM reach GROUP BY id)"""


@query(_COMPONENTS + " SELECT row, col, label FROM veg JOIN lab USING (id)")
def ras9_components(t):
    return raster.components(_vegetation(t), 50, tile=16)


@query(_COMPONENTS + """, pts AS (SELECT p_partkey AS id, p_partkey * 7 % 200 AS row, p_partkey * 11 % 50 AS col FROM part),
own AS (SELECT v.row, v.col, l.label FROM veg v JOIN lab l USING (id)),
s AS (SELECT p.row, p.col, count(*) FILTER (WHERE q.label = c.label)::DOUBLE / count(*) AS share FROM (SELECT DISTINCT row, col FROM pts) p JOIN own c USING (row, col) JOIN own q ON q.row BETWEEN p.row - 5 AND p.row + 5 AND (q.row - p.row) * (q.row - p.row) + (q.col - p.col) * (q.col - p.col) <= 25 GROUP BY 1, 2)
SELECT id, round(coalesce(share, 0), 6) AS share FROM pts LEFT JOIN s USING (row, col)""")
def ras10_continuity(t):
    labels = raster.components(_vegetation(t), 50, tile=16)
    pts = t("part").selectExpr("p_partkey AS id", "p_partkey * 7 % 200 AS row", "p_partkey * 11 % 50 AS col")
    return raster.continuity(pts, labels, "id", 5).select("id", r6("share", "share"))
