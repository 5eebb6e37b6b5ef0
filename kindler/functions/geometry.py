"""Geometry on arrays of points: rings, areas, WKT and a transverse Mercator projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 ellipsoid, the Greek grid (EPSG:2100) and its published shift from WGS84.
A, INV_F = 6378137.0, 298.257222101
LAT0, LON0, K0, FE, FN = 0.0, 24.0, 0.9996, 500000.0, 0.0
SHIFT = (-199.87, 74.79, 246.62)


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x, y>>; the ring may be open or closed."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(twice) / 2


def ring_centroid(ring: Column) -> Column:
    """Area centroid as struct<x, y>; null for a ring without area."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda f: F.aggregate(F.zip_with(ring, following, f), F.lit(0.0), lambda s, v: s + v)
    area = total(cross)
    x = F.try_divide(total(lambda p, q: (p["x"] + q["x"]) * cross(p, q)), 3 * area)
    y = F.try_divide(total(lambda p, q: (p["y"] + q["y"]) * cross(p, q)), 3 * area)
    return F.when(area != 0, F.struct(x.alias("x"), y.alias("y")))


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end; null below three different places."""
    shut = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.size(ring) >= 3, F.when(F.size(shut) >= 4, shut))


def circle_ring(x: Column, y: Column, r: Column, per_quadrant: int = 64) -> Column:
    """Polygon of ``4 * per_quadrant`` points on a circle."""
    step = math.pi / (2 * per_quadrant)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * per_quadrant - 1)), lambda i: F.struct((x + r * F.cos(i * step)).alias("x"), (y + r * F.sin(i * step)).alias("y")))


def to_wkt(ring: Column) -> Column:
    """POLYGON text of a closed ring."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def from_wkt(wkt: Column) -> Column:
    """Outer ring of a POLYGON text as array<struct<x, y>>; null for empty or other geometry."""
    body = F.regexp_extract(wkt, r"^\s*POLYGON\s*\(\(([^()]*)\)", 1)
    points = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))
    return F.when(body != "", points)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test, strictly inside: points on the boundary are outside."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    crosses = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])
    odd = F.aggregate(F.zip_with(ring, following, lambda p, q: F.coalesce(crosses(p, q), F.lit(False))), F.lit(False), lambda s, v: s != v)
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = F.exists(F.zip_with(ring, following, lambda p, q: ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])) & between(x, p["x"], q["x"]) & between(y, p["y"], q["y"])), lambda v: v)
    return odd & ~on


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest edge of the ring."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))

    def one(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.array_min(F.zip_with(ring, following, one))


def _third_flattening() -> float:
    f = 1 / INV_F
    return f / (2 - f)


def project(lon: Column, lat: Column, shift: tuple[float, float, float] | None = SHIFT) -> Column:
    """struct<x, y> in metres on the Greek grid, by the datum shift and Krueger's series to the fourth order."""
    lam, phi = F.radians(lon), F.radians(lat)
    f = 1 / INV_F
    e2 = f * (2 - f)
    if shift:
        # geocentric, moved, and back by Bowring's formula (heights of zero)
        n = A / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
        x, y, z = n * F.cos(phi) * F.cos(lam) - shift[0], n * F.cos(phi) * F.sin(lam) - shift[1], n * (1 - e2) * F.sin(phi) - shift[2]
        p, b = F.hypot(x, y), A * (1 - f)
        theta = F.atan2(z * A, p * b)
        lam = F.atan2(y, x)
        s, c = F.sin(theta), F.cos(theta)
        phi = F.atan2(z + e2 / (1 - e2) * b * s * s * s, p - e2 * A * c * c * c)
    n = _third_flattening()
    a_hat = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(e2)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    d = lam - math.radians(LON0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return F.struct((FE + K0 * a_hat * east).alias("x"), (FN + K0 * a_hat * north).alias("y"))
