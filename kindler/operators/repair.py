"""Repair of rings that cross or touch themselves: noding, faces by the even-odd rule, the largest part.

Edges of one ring meet through square cells about as wide as they are long, so the
edges of a ring are not paired with each other, unless they are few.  Every edge is cut where others cross
or touch it; a piece that runs over the same place an even number of times bounds
nothing and goes.  The pieces left are the border of the even-odd area: what they
enclose is found by walking around each face, in one small step for each ring.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, spread
from .perimeters import finite, numbered, traced_edges

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

#: Areas below this are none.
LEAST_AREA = 1e-12
#: Rings of at most so many edges have them paired with each other.
FEW = 16


def ring_edges(rings: DataFrame) -> DataFrame:
    """(_r, e, x1, y1, x2, y2, size, n, grid) of the edges of ``ring``, without edges of no length; ``size`` is the cell width for the ring, ``n`` the number of its edges.

    Places are snapped to a grid of about 1e-13 of the ring's largest coordinate, so
    that lines which meet in one place do so in the same numbers.
    """
    following = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1))
    edge = rings.select("_r", F.posexplode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("e", "s"))
    edge = edge.select("_r", "e", *[F.col(f"s.{p}.{c}").cast("double").alias(f"{c}{i}") for i, p in ((1, "p"), (2, "q")) for c in ("x", "y")])
    places = ("x1", "y1", "x2", "y2")
    reach = F.max(F.greatest(*[F.abs(F.col(c)) for c in places])).over(Window.partitionBy("_r"))
    grid = F.when(reach > 0, F.pow(F.lit(2.0), F.ceil(F.log2(reach)) - 42)).otherwise(F.lit(1.0))
    edge = edge.where(finite(*places)).withColumn("grid", grid)
    edge = edge.select("_r", "e", "grid", *[(F.rint(F.col(c) / F.col("grid")) * F.col("grid")).alias(c) for c in places])
    edge = edge.where(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))
    edge = edge.withColumn("e", F.row_number().over(Window.partitionBy("_r").orderBy("e")))
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    wide = edge.groupBy("_r").agg(F.avg(length).alias("size"), F.count("*").alias("n"))
    return edge.join(wide.hint("merge"), "_r")


def _cuts(edges: DataFrame) -> DataFrame:
    """(_r, e, x, y, plain): places where an edge meets another one; ``plain`` where they only follow each other."""
    few = edges.where(F.col("n") <= FEW)
    many = traced_edges(edges.where(F.col("n") > FEW), F.col("size"))
    # edges with their ends in order, pairs with their edges in order: an edge that runs back over another one is cut at the very same places
    end = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    side = lambda cells, n, *more: cells.select(*[c for c in ("_r", "gx", "gy") if c in cells.columns], F.col("e").alias(n), F.struct(F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b")).alias(f"l{n}"), *more)
    met = lambda cells, *by: side(cells, "e", "grid").join(side(cells, "f").hint("merge"), list(by)).where("e < f").select("_r", "e", "f", "grid", F.least("le", "lf").alias("p"), F.greatest("le", "lf").alias("q"))
    pairs = met(few, "_r").unionByName(met(many, "_r", "gx", "gy").distinct())
    p, q = ([tuple(F.col(f"{line}.{i}.{c}") for c in ("x", "y")) for i in ("a", "b")] for line in ("p", "q"))
    rx, ry, sx, sy = p[1][0] - p[0][0], p[1][1] - p[0][1], q[1][0] - q[0][0], q[1][1] - q[0][1]
    wx, wy = q[0][0] - p[0][0], q[0][1] - p[0][1]
    cross = rx * sy - ry * sx
    t, u = F.try_divide(wx * sy - wy * sx, cross), F.try_divide(wx * ry - wy * rx, cross)
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    same = lambda v, w: (v[0] == w[0]) & (v[1] == w[1])
    none = F.lit(None).cast("struct<x:double,y:double>")
    shared = F.when(same(p[0], q[0]) | same(p[0], q[1]), place(*p[0])).when(same(p[1], q[0]) | same(p[1], q[1]), place(*p[1])).otherwise(none)
    within = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    met = F.when(t == 0, place(*p[0])).when(t == 1, place(*p[1])).when(u == 0, place(*q[0])).when(u == 1, place(*q[1])).otherwise(place(*(F.rint(v / F.col("grid")) * F.col("grid") for v in (p[0][0] + t * rx, p[0][1] + t * ry))))
    # on one line: every end that lies on the other edge
    on = lambda v, a, b: (v[0] >= F.least(a[0], b[0])) & (v[0] <= F.greatest(a[0], b[0])) & (v[1] >= F.least(a[1], b[1])) & (v[1] <= F.greatest(a[1], b[1]))
    ends = F.array(*[F.when(on(v, *other), place(*v)) for vs, other in ((p, q), (q, p)) for v in vs])
    level = (cross == 0) & (wx * ry - wy * rx == 0)
    places = F.when(level, ends).when((cross != 0) & shared.isNotNull(), F.array(shared)).when((cross != 0) & within, F.array(met)).otherwise(F.array(none))
    hit = pairs.select("_r", "e", "f", level.alias("level"), shared.isNotNull().alias("shared"), F.array_distinct(F.filter(places, lambda v: v.isNotNull())).alias("v")).where(F.size("v") > 0)
    plain = F.col("shared") & (F.size("v") == 1) & ((F.col("f") == F.col("e") + 1) | ((F.col("e") == F.col("low")) & (F.col("f") == F.col("high"))))
    span = edges.groupBy("_r").agg(F.min("e").alias("low"), F.max("e").alias("high"))
    hit = hit.join(span.hint("merge"), "_r").select("_r", F.explode(F.array("e", "f")).alias("e"), "v", plain.alias("plain"))
    return hit.select("_r", "e", F.explode("v").alias("v"), "plain").select("_r", "e", "v.x", "v.y", "plain")


def _pieces(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(_r, ax, ay, bx, by): pieces of edges between neighbouring cuts that occur an odd number of times."""
    ends = [edges.select("_r", "e", F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)]
    places = cuts.select("_r", "e", "x", "y").unionByName(ends[0]).unionByName(ends[1]).distinct()
    along = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    order = Window.partitionBy("_r", "e").orderBy("_t", "x", "y")
    piece = places.join(edges.hint("merge"), ["_r", "e"]).withColumn("_t", along).select("_r", F.struct("x", "y").alias("p"), F.lead(F.struct("x", "y")).over(order).alias("q")).where("q is not null")
    piece = piece.select("_r", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return piece.groupBy("_r", "p", "q").agg(F.count("*").alias("n")).where("n % 2 = 1").select("_r", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def _area(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x[0], y - y[0]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def largest_face(a: np.ndarray, b: np.ndarray):
    """(area, rings) of the largest face inside the pieces a-b, its outer ring first; area 0.0 where there is none."""
    points, index = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    index, n = index.ravel(), len(a)
    tail, head = np.concatenate([index[:n], index[n:]]), np.concatenate([index[n:], index[:n]])
    twin = np.concatenate([np.arange(n) + n, np.arange(n)])
    way = points[head] - points[tail]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), tail))
    rank = np.empty(2 * n, np.int64)
    rank[order] = np.arange(2 * n)
    first, last = np.searchsorted(tail[order], [tail, tail + 1])
    before = np.where(rank == first, last - 1, rank - 1)
    after = order[before[twin]]  # the next half-edge around the face on the left
    seen, best = np.zeros(2 * n, bool), (0.0, [])
    for h in range(2 * n):
        if seen[h]:
            continue
        walk = []
        while not seen[h]:
            seen[h] = True
            walk.append(h)
            h = after[h]
        at = points[tail[walk]]
        if _area(*at.T) > max(best[0], LEAST_AREA) and _odd(walk, points, tail, head, n):
            rings = _simple(tail[walk].tolist())
            areas = [_area(*points[r].T) for r in rings]
            outer = int(np.argmax(areas))
            best = (_area(*at.T), [points[rings[outer]], *(points[r] for i, r in enumerate(rings) if i != outer and len(r) > 2)])
    return _with_holes(best, points, tail, head, n, after) if best[0] else best


def _odd(walk, points, tail, head, n) -> bool:
    """Whether what lies to the left of a walk is inside by the even-odd rule."""
    h = max(walk, key=lambda k: abs(points[head[k], 1] - points[tail[k], 1]))
    p, q = points[tail[h]], points[head[h]]
    if p[1] == q[1]:
        return False
    x, y = (p + q) / 2
    u, v = points[tail[:n]], points[head[:n]]
    cross = (u[:, 1] > y) != (v[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross &= x < (v[:, 0] - u[:, 0]) * (y - u[:, 1]) / (v[:, 1] - u[:, 1]) + u[:, 0]
    cross[h % n] = False
    return bool((cross.sum() + (q[1] > p[1])) % 2)


def _simple(walk: list) -> list:
    """A closed walk cut at repeated points into rings without any."""
    out, stack, at = [], [], {}
    for v in walk:
        if v in at:
            out.append(stack[at[v] :])
            for u in stack[at[v] + 1 :]:
                del at[u]
            stack = stack[: at[v] + 1]
        else:
            at[v] = len(stack)
            stack.append(v)
    return [*out, stack]


def _with_holes(best, points, tail, head, n, after):
    """The face without the borders that lie inside it and are not connected with its own."""
    area, rings = best
    outer, seen = rings[0], np.zeros(2 * n, bool)
    for h in range(2 * n):
        walk = []
        while not seen[h]:
            seen[h] = True
            walk.append(h)
            h = after[h]
        if not walk:
            continue
        at = points[tail[walk]]
        own = _area(*at.T)
        if own < -LEAST_AREA and _odd(walk, points, tail, head, n) and _holds(outer, (at[0] + at[1]) / 2) and not any(_holds(r, (at[0] + at[1]) / 2) for r in rings[1:]):
            area, rings = area + own, [*rings, at]
    return area, rings


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    u, v = ring, np.roll(ring, -1, axis=0)
    cross = (u[:, 1] > p[1]) != (v[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross &= p[0] < (v[:, 0] - u[:, 0]) * (p[1] - u[:, 1]) / (v[:, 1] - u[:, 1]) + u[:, 0]
    return bool(cross.sum() % 2)


def _faces(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            e = np.array([[s["ax"], s["ay"], s["bx"], s["by"]] for s in r["pieces"]], float).reshape(-1, 4)
            area, rings = largest_face(e[:, :2], e[:, 2:])
            out.append({"_r": r["_r"], "area": area, "rings": [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]})
        kind = pa.schema([("_r", pa.int64()), ("area", pa.float64()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
        yield pa.RecordBatch.from_pylist(out, kind)


def repaired(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, rings, area, repaired) of rows whose ring encloses something.

    ``ring`` is an array of points, open or closed.  Rings that neither cross nor
    touch themselves come back as they are.  Of the others the even-odd area is
    taken, and of its parts the largest: its outer ring, then its holes.  Null and
    empty rings, those with missing coordinates or of fewer than three different
    places, and those that enclose nothing have no row.  Rows that repeat a key are
    rows of their own.
    """
    rows = numbered(spread(rings.select(key, F.col(ring).alias("ring")).where(F.size("ring") >= 3)), "_r")
    whole = F.forall("ring", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    edges = checkpointed(ring_edges(rows.where(whole)))
    cuts = checkpointed(_cuts(edges))
    odd = checkpointed(cuts.where("not plain").select("_r").distinct())
    pieces = _pieces(edges.join(odd.hint("merge"), "_r"), cuts.join(odd.hint("merge"), "_r"))
    made = pieces.repartition(max(1, rows.count() // 2_000), "_r").groupBy("_r").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("pieces")).mapInArrow(_faces, "_r long, area double, rings array<array<struct<x:double,y:double>>>")
    from ..functions.geometry import ring_area

    plain = rows.where(whole).join(odd.hint("merge"), "_r", "left_anti").select(key, F.array("ring").alias("rings"), ring_area(F.col("ring")).alias("area"), F.lit(False).alias("repaired"))
    mended = rows.join(made.hint("merge"), "_r").select(key, "rings", "area", F.lit(True).alias("repaired"))
    return plain.unionByName(mended).where(F.col("area") >= LEAST_AREA)
