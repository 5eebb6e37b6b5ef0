"""Perimeters and ring repair against plain versions."""

import math
import random
from fractions import Fraction

import pytest

from kindler.operators import perimeters, repair

POINT = "array<struct<x:double,y:double>>"


def edges(parts):
    """(outer, a, b) of every edge; rings of fewer than three points have none."""
    for part in parts or []:
        for k, ring in enumerate(part):
            if len(ring) >= 3:
                for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                    yield k == 0, a, b


def distance(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def inside(parts, x, y):
    for part in parts or []:
        odd = on = False
        for _, a, b in edges([part]):
            odd ^= (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]
            on |= (b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])
        if odd and not on:
            return True
    return False


def fire_history(points, shapes, reference=2024):
    """shapes: (pid, yr, distance to the line, distance to the area, strictly inside), the distances as functions of a place."""
    out = []
    for i, x, y in points:
        if x is None or y is None or x != x:
            out.append((i, None, None, 0, 0, 0, 0.0))
            continue
        line = [(f(x, y), pid) for pid, _, f, _, _ in shapes]
        near = [(g(x, y), yr) for _, yr, _, g, _ in shapes]
        best = min(line, default=(None, None))
        out.append((i, *best, sum(d < 5000 for d, _ in near), sum(d < 10000 for d, _ in near), int(any(h(x, y) for *_, h in shapes)), sum(1 / (reference - yr + 1) for d, yr in near if d < 10000 and yr)))
    return out


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def star(r, cx, cy, size, n):
    return [(cx + size * (0.5 + r.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.5 + r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def some_points(r, n):
    points = [(i, r.uniform(-20_000, 120_000), r.uniform(-20_000, 120_000)) for i in range(n)]
    # on an edge, on a corner, within, without coordinates, far away, repeated rows and a repeated id
    return points + [(900, 30_000.0, 35_000.0), (901, 30_000.0, 30_000.0), (902, 35_000.0, 35_000.0), (903, None, 1.0), (904, float("nan"), 1.0), (905, 1e6, -1e6), (7, 1.0, 1.0), (7, 1.0, 1.0), (7, 50_000.0, 2.0)]


@pytest.mark.parametrize("many", [1, 40])
def test_perimeters_against_brute_force(spark, many):
    r = random.Random(many)
    given = [(60, 2010, [[[(30_000.0, 30_000.0), (40_000.0, 30_000.0), (40_000.0, 40_000.0), (30_000.0, 40_000.0), (30_000.0, 30_000.0)]]])]
    for i in range(many):
        cx, cy, size = r.uniform(0, 90_000), r.uniform(0, 90_000), r.choice([300, 2_000, 9_000, 20_000])
        hole = [(cx - size / 5, cy - size / 5), (cx + size / 5, cy - size / 5), (cx + size / 5, cy + size / 5), (cx - size / 5, cy + size / 5)]
        given.append((i, 2000 + i % 20, [[star(r, cx, cy, size, r.randint(3, 14)), hole], *([[star(r, cx + 4 * size, cy, size / 2, 5)]] if i % 3 == 0 else [])]))
    given += [given[-1], (50, None, [[[(1.0, 1.0), (2.0, 2.0)]]]), (51, 2001, None), (52, 2001, []), (53, None, [[star(r, 5_000, 5_000, 800, 6)]])]
    points = some_points(r, 150)

    def shape(pid, yr, parts):
        own = list(edges(parts))
        line = lambda x, y: min(distance(x, y, a, b) for o, a, b in own if o)
        return pid, yr, line, lambda x, y: 0.0 if inside(parts, x, y) else min(distance(x, y, a, b) for _, a, b in own), lambda x, y: inside(parts, x, y)

    p = spark.createDataFrame(points, "id int, x double, y double")
    f = spark.createDataFrame(given, f"pid int, yr int, parts array<array<{POINT}>>")
    want = fire_history(points, [shape(*g) for g in given if list(edges(g[2]))])
    assert rounded(map(tuple, perimeters.perimeter_features(p, f, "id", 2024).collect())) == rounded(want)
    near = perimeters.nearest_boundary(p, f, "id").select("id", "dist", "pid").collect()
    assert rounded(map(tuple, near)) == rounded(w[:3] for w in want)


def test_no_perimeters_and_no_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "id int, x double, y double")
    f = spark.createDataFrame([], f"pid int, yr int, parts array<array<{POINT}>>")
    c = spark.createDataFrame([], "fid int, fx double, fy double, r double, yr int")
    for made in (perimeters.perimeter_features(p, f, "id", 2024), perimeters.circle_features(p, c, "id", 2024)):
        assert [tuple(x) for x in made.collect()] == [(1, None, None, 0, 0, 0, 0.0)] * 2
    assert perimeters.perimeter_features(p.where("false"), f, "id", 2024).count() == 0


@pytest.mark.parametrize("many", [2, 60])
def test_circles_against_brute_force(spark, many):
    r = random.Random(many)
    given = [(i, r.uniform(0, 90_000), r.uniform(0, 90_000), r.choice([0.0, 10.0, 300.0, 3_000.0, 30_000.0]), r.choice([2003, 2011, None])) for i in range(many)]
    given += [given[0], (70, None, 1.0, 1.0, 2000), (71, 5.0, 5.0, -1.0, 2000)]
    points = some_points(r, 150)

    def shape(fid, fx, fy, q, yr):
        gap = lambda x, y: math.hypot(x - fx, y - fy) - q
        return fid, yr, lambda x, y: abs(gap(x, y)), gap, lambda x, y: gap(x, y) < 0

    want = fire_history(points, [shape(*g) for g in given if g[1] is not None and g[3] >= 0])
    made = perimeters.circle_features(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(given, "fid int, fx double, fy double, r double, yr int"), "id", 2024)
    assert rounded(map(tuple, made.collect())) == rounded(want)


# --- repair


def largest_part(ring):
    """Area of the largest part of the even-odd area, from slabs between all corners and crossings, in fractions."""
    ring = [(Fraction(x), Fraction(y)) for x, y in ring]
    lines = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]
    ys = {p[1] for p in ring}
    for i, (a, b) in enumerate(lines):
        for c, d in lines[i + 1 :]:
            cross = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if cross:
                ys.add(a[1] + ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / cross * (b[1] - a[1]))
    ys = sorted(ys)
    at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
    root, area, before = [], [], []

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for low, high in zip(ys[:-1], ys[1:], strict=True):
        over: dict = {}
        for e in lines:
            if min(e[0][1], e[1][1]) <= low and high <= max(e[0][1], e[1][1]):
                side = (at(e, low), at(e, high))
                over[side] = over.get(side, 0) + 1
        sides = sorted((s for s, n in over.items() if n % 2), key=lambda s: (s[0] + s[1], s))
        now = []
        for l, r in zip(sides[::2], sides[1::2], strict=True):
            k = len(root)
            root.append(k)
            area.append((r[0] - l[0] + r[1] - l[1]) * (high - low) / 2)
            for a, b, other in before:
                if min(b, r[0]) > max(a, l[0]):
                    root[find(other)] = find(k)
            now.append((l[1], r[1], k))
        before = now
    total: dict = {}
    for k, x in enumerate(area):
        total[find(k)] = total.get(find(k), 0) + x
    return float(max(total.values(), default=0))


def test_repair_against_slabs(spark):
    r = random.Random(2)
    rings = [[(float(r.randint(0, 9)), float(r.randint(0, 9))) for _ in range(r.randint(3, 9))] for _ in range(300)]
    rings += [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0), (2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0), (2.0, 2.0), (0.0, 0.0)]]  # a hole behind a double edge
    rows = [(i, x) for i, x in enumerate(rings)]
    awkward = [(900, None), (901, []), (902, [(1.0, 1.0), (2.0, 2.0)]), (903, [(0.0, 0.0), (1.0, None), (1.0, 1.0)]), (904, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]), (905, [(1.0, 1.0)] * 5), (906, [(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)])]
    made = repair.repaired(spark.createDataFrame(rows + awkward + [(7, rings[7]), (7, rings[8])], f"id int, ring {POINT}"), "id").collect()
    want = sorted((i, round(a, 6)) for i, x in [*rows, (7, rings[7]), (7, rings[8])] if (a := largest_part(x)) > 0)
    assert sorted((m["id"], round(m["area"], 6)) for m in made) == want
    for m in made:
        parts = [[(p["x"], p["y"]) for p in ring] for ring in m["rings"]]
        size = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        assert size(parts[0]) - sum(map(size, parts[1:])) == pytest.approx(m["area"])


def test_simple_rings_stay_as_they_are(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    got = repair.repaired(spark.createDataFrame([(1, ring)], f"id int, ring {POINT}"), "id").first()
    assert (got["area"], got["repaired"], [tuple(p) for p in got["rings"][0]]) == (8.0, False, ring)
