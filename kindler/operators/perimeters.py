"""Distances from points to perimeters: polygons of several parts with holes, or circles.

Boundaries are cut into edges and traced into the square cells that they cross.
Nothing is decided point by point that a cell decides for all its points: what a
point's cell knows about the distance of its centre, give or take half a diagonal,
settles most thresholds and leaves few edges to measure.

* Fire histories: points and the pieces of perimeters that can be within the far
  limit meet by blocks, in arrays (``history``).  Nothing makes a row for a pair,
  nor for a cell and a piece.
* Nearest boundary of points far from all: cells descend a pyramid of traced cells;
  of the nodes at a level those stay whose nearest corner is not farther than the
  farthest corner of another one.  The edges in the cells that remain are measured
  from each point.

There is one way for any number of perimeters, none included, and for any number
of points; rows are told apart by a number of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from . import history

#: Cells in the near distance; half a diagonal must be far below it.
FINE = 8
#: Rounding: shares by which bounds are widened.
SLACK = 1e-6
#: Rows of a task, about, and of one side of a group at most.
SOME, MOST = 250_000, 500_000
#: What a distance is taken from.
EDGE, CIRCLE = ["x1", "y1", "x2", "y2"], ["fx", "fy", "r"]


def finite(*columns: str) -> Column:
    return F.expr(" and ".join(f"abs(`{c}`) < double('Infinity')" for c in columns))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row, fixed by a checkpoint."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def edges_of(perimeters: DataFrame, *keep: str) -> DataFrame:
    """``keep``, part, outer, x1, y1, x2, y2 of every edge of ``parts`` (array of parts, each an array of rings, the outer one first).

    Rings may be open or closed; rings of fewer than three points, and edges with
    missing coordinates, are left out.
    """
    ring = perimeters.select(*keep, F.posexplode("parts").alias("part", "rings")).select(*keep, "part", F.posexplode("rings").alias("ring", "points")).where(F.size("points") >= 3)
    following = F.concat(F.slice("points", F.lit(2), F.size("points")), F.slice("points", 1, 1))
    edge = ring.select(*keep, "part", (F.col("ring") == 0).alias("outer"), F.explode(F.arrays_zip(F.col("points").alias("p"), following.alias("q"))).alias("e"))
    edge = edge.select(*keep, "part", "outer", *[F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{i}") for i, p in ((1, "p"), (2, "q")) for c in ("x", "y")])
    return edge.where(finite("x1", "y1", "x2", "y2"))


def _steps(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))


def traced_edges(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` with gx, gy of every cell that they cross, and perhaps neighbours that they touch."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    d = edges.withColumn("gx", _steps(F.least(x1, x2), F.greatest(x1, x2), size))
    at = lambda x: F.when(x1 == x2, y1).otherwise(y1 + (y2 - y1) * F.try_divide(x - x1, x2 - x1))
    a, b = at(F.greatest(F.col("gx") * size, F.least(x1, x2))), at(F.least((F.col("gx") + 1) * size, F.greatest(x1, x2)))
    a, b = F.when(x1 == x2, y1).otherwise(a), F.when(x1 == x2, y2).otherwise(b)
    return d.withColumn("gy", _steps(F.least(a, b) - size * SLACK, F.greatest(a, b) + size * SLACK, size))


def traced_circles(circles: DataFrame, size: float) -> DataFrame:
    """``circles`` with gx, gy of every cell that their line crosses, and perhaps neighbours."""
    fx, fy, r = F.col("fx"), F.col("fy"), F.col("r")
    d = circles.withColumn("gx", _steps(fx - r, fx + r, size))
    a, b = F.greatest(F.col("gx") * size, fx - r) - fx, F.least((F.col("gx") + 1) * size, fx + r) - fx
    half = lambda x: F.sqrt(F.greatest(r * r - x * x, F.lit(0.0)))
    low, high = F.least(half(a), half(b)), F.when((a <= 0) & (b >= 0), r).otherwise(F.greatest(half(a), half(b)))
    eps = size * SLACK
    arc = F.array(F.struct((fy + low - eps).alias("a"), (fy + high + eps).alias("b")), F.struct((fy - high - eps).alias("a"), (fy - low + eps).alias("b")))
    d = d.withColumn("_arc", F.explode(arc))
    return d.withColumn("gy", _steps(F.col("_arc.a"), F.col("_arc.b"), size)).drop("_arc")


def _nearest_cells(cells: DataFrame, traced: DataFrame, size: float) -> DataFrame:
    """(qx, qy, gx, gy): for each cell the traced cells in which its points' nearest boundary can lie."""
    levels = [checkpointed(traced.select("gx", "gy").distinct())]
    ends = levels[0].agg(*[f(c).alias(f"{name}{c}") for c in ("gx", "gy") for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["logx"] is None:
        return cells.where("false").select("qx", "qy", F.col("qx").alias("gx"), F.col("qy").alias("gy"))
    while any((ends[f"hi{c}"] >> 2 * (len(levels) - 1)) - (ends[f"lo{c}"] >> 2 * (len(levels) - 1)) > 3 for c in ("gx", "gy")):
        levels.append(levels[-1].select(F.shiftright("gx", 2).alias("gx"), F.shiftright("gy", 2).alias("gy")).distinct())
    top = F.array(*[F.struct(F.lit(r["gx"]).cast("long").alias("gx"), F.lit(r["gy"]).cast("long").alias("gy")) for r in levels[-1].collect()])  # at most 16
    near = cells.select("qx", "qy", F.inline(top))
    for level in range(len(levels) - 1, -1, -1):
        if level < len(levels) - 1:
            child = levels[level].select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.shiftright("gx", 2).alias("gx"), F.shiftright("gy", 2).alias("gy"))
            near = near.join(child.hint("merge"), ["gx", "gy"]).select("qx", "qy", F.col("cx").alias("gx"), F.col("cy").alias("gy"))
        wide, gap, span = size * 4**level, [], []
        for q, g in (("qx", "gx"), ("qy", "gy")):
            a, b = F.col(g) * wide - (F.col(q) + 1) * size, F.col(q) * size - (F.col(g) + 1) * wide
            gap.append(F.greatest(a, b, F.lit(0.0)))
            span.append(F.greatest(F.abs((F.col(g) + 1) * wide - F.col(q) * size), F.abs((F.col(q) + 1) * size - F.col(g) * wide)))
        near = near.withColumn("_lo", gap[0] * gap[0] + gap[1] * gap[1])
        near = near.withColumn("_hi", F.min(span[0] * span[0] + span[1] * span[1]).over(Window.partitionBy("qx", "qy")))
        near = near.where(F.col("_lo") <= F.col("_hi") * (1 + SLACK)).select("qx", "qy", "gx", "gy")
    return near


def _reached(pieces: DataFrame, box: dict, far: float, left: Column | None) -> DataFrame:
    """``pieces`` with gx, gy of every block of ``far`` where places within ``far`` of them can lie.

    ``left``: the least x of a piece's part; an edge also goes to the blocks on its
    own lines between there and itself, as lines from there to the right cross it.
    """
    by = lambda c: F.floor(c / far).cast("long")
    wide = far * (1 + SLACK)
    d = pieces.withColumn("gy", F.explode(F.sequence(by(box["y"][0] - wide), by(box["y"][1] + wide))))
    first = by(box["x"][0] - wide)
    if left is not None:
        own = F.col("gy").between(by(box["y"][0] - far * SLACK), by(box["y"][1] + far * SLACK))
        first = F.when(own, F.least(first, by(left - wide))).otherwise(first)
    return d.withColumn("gx", F.explode(F.sequence(first, by(box["x"][1] + wide))))


def _shares(counts: DataFrame, name: str) -> DataFrame:
    """Blocks with more than ``MOST`` rows, and in how many shares they are dealt; no more blocks than a ``MOST``-th of the rows."""
    return F.broadcast(checkpointed(counts.where(F.col("count") > MOST).select("gx", "gy", F.ceil(F.col("count") / MOST).alias(name))))


def _features(points: DataFrame, pieces: DataFrame, columns: list[str], box: dict, size: float, near: float, far: float, left: Column | None, trace) -> DataFrame:
    """``points`` (_r, x, y, qx, qy and what else it has) with the features of a fire history.

    ``pieces`` (_p, pid, w, part, outer, ``columns``) are edges or circles, ``box``
    their extent, and ``trace`` gives the cells of their lines.  Points and pieces
    meet by blocks; a block of very many is dealt in shares of both, whose features
    are put together.  Points without a line within ``far`` look for it by cells.
    """
    block = ["gx", "gy"]
    kind = pieces.schema["pid"].dataType.simpleString()
    place = lambda c: F.floor(F.col(c) / far).cast("long")
    spots = points.where("qx is not null").select("_r", "x", "y", place("x").alias("gx"), place("y").alias("gy"))
    reached = _reached(pieces, box, far, left).select(*block, "_p", "pid", "part", "outer", "w", *columns)
    many = [checkpointed(d.groupBy(*block).count()) for d in (spots, reached)]
    rows = sum(d.agg(F.sum("count")).first()[0] or 0 for d in many)
    tasks = max(1, -(-rows // SOME))
    of_points, of_pieces = _shares(many[0], "_a"), _shares(many[1], "_b")
    dealt = lambda d, other, one, own, all_, n, by: d.join(one, block, "left").join(other, block, "left").withColumn(own, F.pmod(F.col(by), F.coalesce(n, F.lit(1)))).withColumn(all_[0], F.explode(F.sequence(F.lit(0), F.coalesce(F.col(all_[1]), F.lit(1)) - 1)))
    here = dealt(spots, of_pieces, of_points, "_i", ("_k", "_b"), F.col("_a"), "_r").select(*block, "_i", "_k", "_r", "x", "y").repartition(tasks, *block, "_i", "_k")
    there = dealt(reached, of_points, of_pieces, "_k", ("_i", "_a"), F.col("_b"), "_p").withColumnsRenamed({c: f"_{c}_" for c in (*block, "_i", "_k")})
    there = there.select("_gx_", "_gy_", "__i_", "__k_", "_p", "pid", "part", "outer", "w", *columns).repartition(tasks, "_gx_", "_gy_", "__i_", "__k_")
    made = here.groupBy(*block, "_i", "_k").cogroup(there.groupBy("_gx_", "_gy_", "__i_", "__k_")).applyInArrow(history.histories(columns, near, far, size), f"_r long, d double, pid {kind}, near long, far long, inside long, w double")
    nearest = F.min(F.when(F.col("d").isNotNull(), F.struct("d", "pid"))).alias("_n")
    made = checkpointed(made.groupBy("_r").agg(nearest, *[F.sum(c).alias(f"_{c}") for c in ("near", "far", "inside", "w")]))
    out = points.join(made.hint("merge"), "_r", "left")
    known = F.col("_n.d") < far * (1 - SLACK)
    lost = checkpointed(out.where("qx is not null").where(~F.coalesce(known, F.lit(False))).select("_r", "x", "y", *[F.floor(F.col(c) / near).cast("long").alias(q) for c, q in (("x", "qx"), ("y", "qy"))]))
    outer = pieces.where("outer")
    if not lost.isEmpty() and not outer.isEmpty():
        traced = checkpointed(trace(outer, near).select("pid", *columns, "gx", "gy"))
        cells = checkpointed(lost.select("qx", "qy").distinct())
        lines = _nearest_cells(cells, traced, near).join(traced.hint("merge"), block).drop(*block).distinct()
        found = _measured(lost, lines, columns).select("_r", F.struct("d", "pid").alias("_f"))
        out = out.join(found.hint("merge"), "_r", "left").withColumn("_n", F.coalesce("_f", "_n"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        *[c for c in points.columns if c not in ("_r", "x", "y", "qx", "qy")],
        F.col("_n.d").alias("dist_to_nearest_fire_m"), F.col("_n.pid").alias("nearest_fire"),
        count("_near").alias("fire_count_5km"), count("_far").alias("fire_count_10km"),
        (count("_inside") > 0).cast("int").alias("ever_burned"), F.coalesce("_w", F.lit(0.0)).alias("recency_score"),
    )


def _spots(points: DataFrame, key: str, size: float) -> DataFrame:
    place = lambda c: F.when(finite("x", "y"), F.floor(F.col(c) / size).cast("long"))
    rows = points.select(F.col(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return numbered(rows.withColumn("qx", place("x")).withColumn("qy", place("y")), "_r")


def _weight(reference_year: int) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), (reference_year - F.col("yr") + 1).cast("double")), F.lit(0.0))


def perimeter_features(points: DataFrame, perimeters: DataFrame, key: str, reference_year: int, near: float = 5_000.0, far: float = 10_000.0, pid: str = "pid") -> DataFrame:
    """One row per row of ``points`` (key, x, y): its fire history by polygons.

    ``perimeters`` has pid, yr and parts (parts of rings of points, the outer ring
    first).  dist_to_nearest_fire_m is the distance to the nearest outer ring, also
    from inside, and nearest_fire the perimeter it belongs to (ties: the smallest);
    fire_count_5km and fire_count_10km count perimeters whose area is strictly
    nearer than ``near`` and ``far``; ever_burned is 1 strictly inside one;
    recency_score adds 1 / (reference_year - yr + 1) of those within ``far``.

    Without perimeters the distance is null and the rest zero; so it is for points
    without finite coordinates.  Repeated rows, of points and of perimeters, are
    rows of their own.  A perimeter without a year has no weight; rings of fewer
    than three points are none.
    """
    size = near / FINE
    spots = _spots(points, key, size)
    own = numbered(perimeters.select(F.col(pid).alias("pid"), _weight(reference_year).alias("w"), "parts"), "_p")
    box = {c: (F.least(f"{c}1", f"{c}2"), F.greatest(f"{c}1", f"{c}2")) for c in ("x", "y")}
    pieces = edges_of(own, "_p", "pid", "w").withColumn("_left", F.min(box["x"][0]).over(Window.partitionBy("_p", "part")))
    return _features(spots, checkpointed(pieces), EDGE, box, size, near, far, F.col("_left"), traced_edges)


def circle_features(points: DataFrame, circles: DataFrame, key: str, reference_year: int, near: float = 5_000.0, far: float = 10_000.0, pid: str = "fid") -> DataFrame:
    """The same for circles (fx, fy, r, yr): the boundary is the circle, the area the disc; circles without finite values or with r < 0 are none."""
    size = near / FINE
    spots = _spots(points, key, size)
    named = F.col(pid) if pid in circles.columns else F.lit(None).cast("long")
    own = circles.where(finite("fx", "fy", "r") & (F.col("r") >= 0)).select(named.alias("pid"), _weight(reference_year).alias("w"), *[F.col(c).cast("double").alias(c) for c in CIRCLE], F.lit(0).alias("part"), F.lit(True).alias("outer"))
    box = {c: (F.col(f"f{c}") - F.col("r"), F.col(f"f{c}") + F.col("r")) for c in ("x", "y")}
    return _features(spots, numbered(own, "_p"), CIRCLE, box, size, near, far, None, traced_circles)


def nearest_boundary(points: DataFrame, perimeters: DataFrame, key: str, pid: str = "pid", cell: float = 1_000.0) -> DataFrame:
    """One row per row of ``points``: key, the nearest perimeter by its outer rings (ties: the smallest id) and the distance; nulls where there is none."""
    spots = _spots(points, key, cell)
    pieces = edges_of(perimeters.select(F.col(pid).alias("pid"), "parts"), "pid").where("outer")
    traced = checkpointed(traced_edges(pieces, cell).select("pid", "x1", "y1", "x2", "y2", "gx", "gy"))
    known = spots.where("qx is not null").select("_r", "x", "y", "qx", "qy")
    # an edge of another cell is at least as far as the border of a point's own one
    border = F.least(*[F.least(F.col(c) - F.col(q) * cell, (F.col(q) + 1) * cell - F.col(c)) for c, q in (("x", "qx"), ("y", "qy"))])
    own = checkpointed(_measured(known, traced.withColumnsRenamed({"gx": "qx", "gy": "qy"}), EDGE))
    settled = own.join(known.hint("merge"), "_r").where(F.col("d") < border * (1 - SLACK)).select("_r", "d", "pid")
    open_ = checkpointed(known.join(settled.select("_r").hint("merge"), "_r", "left_anti"))
    cells = checkpointed(open_.select("qx", "qy").distinct())
    near = _nearest_cells(cells, traced, cell).join(traced.hint("merge"), ["gx", "gy"]).drop("gx", "gy").distinct()
    found = settled.unionByName(_measured(open_, near, EDGE))
    return spots.join(found.hint("merge"), "_r", "left").select(key, F.col("pid").alias(pid), F.col("d").alias("dist"))


def _measured(points: DataFrame, pieces: DataFrame, columns: list[str]) -> DataFrame:
    """(_r, d, pid): for each point the nearest of the edges or circles of its cell (ties: the smallest pid), without a row for a pair."""
    kind = pieces.schema["pid"].dataType.simpleString()

    def nearest(p, e):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not p.num_rows or not e.num_rows:
            return pa.table({"_r": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "pid": pa.array([], e.schema.field("pid").type)})
        e = e.take(pc.sort_indices(e, [("pid", "ascending")], null_placement="at_start"))
        own, xs, ys = [e.column(c).to_numpy() for c in columns], p.column("x").to_numpy(), p.column("y").to_numpy()
        best, at, step = np.empty(len(xs)), np.empty(len(xs), np.int64), max(1, 1_000_000 // len(own[0]))
        for i in range(0, len(xs), step):
            x, y = xs[i : i + step, None], ys[i : i + step, None]
            d = history.edge_distance(x, y, own) if len(own) == 4 else np.abs(history.circle_distance(x, y, own))
            at[i : i + step] = d.argmin(axis=1)
            best[i : i + step] = d.min(axis=1)
        return pa.table({"_r": p.column("_r"), "d": pa.array(best), "pid": e.column("pid").take(pa.array(at))})

    pieces = pieces.select("pid", *columns, F.col("qx").alias("_ex"), F.col("qy").alias("_ey"))
    return points.groupBy("qx", "qy").cogroup(pieces.groupBy("_ex", "_ey")).applyInArrow(nearest, f"_r long, d double, pid {kind}")
