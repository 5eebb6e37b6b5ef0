"""Nearest-neighbour, radius and containment joins.

Points meet through grid cells, an equi-join, so nothing is compared with
everything.  Only sides whose size was counted are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, dealt
from .perimeters import circle_features  # noqa: F401

#: Polygons of at most this many rows are broadcast whole; for nearest neighbours, a side that is compared with every row.
SMALL, COMPARED = 2_000, 128

#: Places that a row meets in its own cell, on average, when its nearest one is searched; how often cells are quartered for that, at most.
MET, FINER = 16, 12

#: Points and places of a block that one task holds at most, when their radius is searched.
BLOCK_POINTS, BLOCK_PLACES = 50_000, 1_000_000


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _spot(key: str, x: str = "x", y: str = "y") -> Column:
    """What tells points apart: the id and the place, so rows that repeat an id have answers of their own."""
    return F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))


def radius_pairs(left: DataFrame, right: DataFrame, r: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", inclusive: bool = True) -> DataFrame:
    """Rows of both sides at most (or less than) ``r`` apart, with ``d2``; column names must differ."""
    l = left.withColumn("_gx", _cell(lx, r)).withColumn("_gy", _cell(ly, r))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rr = right.withColumn("_gx", F.explode(F.transform(around, lambda k: _cell(rx, r) + k))).withColumn("_gy", F.explode(F.transform(around, lambda k: _cell(ry, r) + k)))
    d2 = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    pairs = l.join(rr, ["_gx", "_gy"]).withColumn("d2", d2).drop("_gx", "_gy")
    return pairs.where(F.col("d2") <= r * r) if inclusive else pairs.where(F.col("d2") < r * r)


def radius_count(left: DataFrame, right: DataFrame, r: float, key: str, out: str, rx: str = "rx", ry: str = "ry", other: str | None = None, inclusive: bool = True) -> DataFrame:
    """``left`` (key, x, y) with the number of ``right`` points in reach; ``other``: right's id, to leave out the row itself.

    Rows that repeat an id are counted apart, each at its place; of rows that repeat
    id and place each has the one number.  Both sides meet in blocks, where ``reach.counts`` makes no row for a pair.
    Right points at one place travel once, with their number, and packed; crowded
    blocks are dealt to several tasks.  No side is broadcast, whatever its size is taken for.
    """
    from . import reach

    far = r * (1 + reach.SLACK)
    block = 2 * far
    finite = lambda *cols: F.expr(" and ".join(f"abs(`{c}`) < double('Infinity')" for c in cols))
    right = right.where(F.col(other).isNotNull()) if other else right
    known = F.col(key).isNotNull() if other else F.lit(True)
    points = left.where(finite("x", "y") & known).select(_spot(key).alias("_k"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).distinct()
    kind = points.schema["_k"].dataType.simpleString()
    points = points.withColumn("_gx", _cell("_x", block)).withColumn("_gy", _cell("_y", block))
    places = right.where(finite(rx, ry)).groupBy(F.col(rx).cast("double").alias("_x"), F.col(ry).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    packed = checkpointed(places.mapInArrow(reach.packing(far), "_hx long, _hy long, _m long, _p binary"))  # sized first, then dealt
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / 2), F.floor((F.col(c) + 1) / 2)))
    dealt = packed.withColumn("_gx", touched("_hx")).withColumn("_gy", touched("_hy")).drop("_hx", "_hy")
    sizes = points.select("_gx", "_gy", F.lit(1).cast("long").alias("_l"), F.lit(0).cast("long").alias("_m")).unionByName(dealt.select("_gx", "_gy", F.lit(0).cast("long").alias("_l"), "_m"))
    parts = lambda c, most: F.greatest(F.ceil(F.sum(c) / most), F.lit(1)).cast("int")
    sizes = sizes.groupBy("_gx", "_gy").agg(parts("_l", BLOCK_POINTS).alias("_a"), parts("_m", BLOCK_PLACES).alias("_b"))
    crowded = sizes.where("_a > 1 or _b > 1").collect()  # a row for each BLOCK_POINTS at most
    crowded = left.sparkSession.createDataFrame(crowded, sizes.schema) if crowded else None
    points, dealt = (_dealt(df, crowded, own, rest) for df, own, rest in ((points, "_a", "_b"), (dealt, "_b", "_a")))
    blocks = ["_gx", "_gy", "_a", "_b"]
    both = points.select(*blocks, "_k", "_x", "_y", F.lit(None).cast("long").alias("_m"), F.lit(None).cast("binary").alias("_p")).unionByName(dealt.select(*blocks, F.lit(None).cast(kind).alias("_k"), F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), "_m", "_p"))

    def count(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        l, p = t.filter(pc.is_null(t.column("_m"))), t.filter(pc.is_valid(t.column("_m")))
        n = reach.counts(l.column("_x").to_numpy(), l.column("_y").to_numpy(), *reach.unpacked(p.column("_m").to_pylist(), p.column("_p").to_pylist()), r, inclusive)
        return pa.table({"_k": l.column("_k"), "_n": pa.array(n)}).filter(pa.array(n > 0))

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = both.repartition(tasks, *blocks).groupBy(*blocks).applyInArrow(count, f"_k {kind}, _n long")
    if other:
        d2 = (F.col("x") - F.col(rx)) * (F.col("x") - F.col(rx)) + (F.col("y") - F.col(ry)) * (F.col("y") - F.col(ry))
        own = left.where(finite("x", "y")).select(_spot(key).alias("_k"), "x", "y", F.col(key).alias("_i")).distinct().join(right.select(F.col(other).alias("_i"), rx, ry).hint("merge"), "_i")
        counts = counts.unionByName(own.where(d2 <= r * r if inclusive else d2 < r * r).select("_k", F.lit(-1).cast("long").alias("_n")))
    counts = counts.groupBy("_k").agg(F.sum("_n").alias(out))
    return left.withColumn("_k", _spot(key)).join(counts.hint("merge"), "_k", "left").drop("_k").withColumn(out, F.coalesce(out, F.lit(0)))


def _dealt(df: DataFrame, crowded: DataFrame | None, own: str, rest: str) -> DataFrame:
    """Rows of crowded blocks dealt over ``own`` parts by a hash, with a copy for each part of the other side; other blocks have one part."""
    if crowded is None:
        return df.withColumns({own: F.lit(0), rest: F.lit(0)})
    d = df.join(F.broadcast(crowded), ["_gx", "_gy"], "left")
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c in ("_k", "_x", "_y", "_p")]), F.coalesce(own, F.lit(1))).cast("int")
    return d.withColumn(own, part).withColumn(rest, F.explode(F.sequence(F.lit(0), F.coalesce(rest, F.lit(1)) - 1)))


def nearest(left: DataFrame, right: DataFrame, key: str, rid: str, x: str = "x", y: str = "y", rx: str = "rx", ry: str = "ry", cell: float | None = None) -> DataFrame:
    """``left`` with the nearest ``right`` row (struct ``near``) and ``dist2``; ties go to the smallest ``rid``.

    A counted small side is broadcast.  Otherwise a row first meets the points of
    its own and the eight cells around it, and is settled if the best one is nearer
    than a cell.  The others descend a pyramid of occupied cells: of the cells left
    at a level, those stay whose nearest corner is not farther than the farthest
    corner of another one.  Rows without coordinates match nothing.

    Rows that repeat an id have answers of their own, each at its place.  Points at one place count once, as their smallest ``rid``.  Cells are at most
    ``cell`` wide, and smaller where rows would meet many points.
    """
    right = right.where(F.col(rx).isNotNull() & F.col(ry).isNotNull())
    d2 = (F.col(x) - F.col(rx)) * (F.col(x) - F.col(rx)) + (F.col(y) - F.col(ry)) * (F.col(y) - F.col(ry))
    best = lambda pairs: pairs.groupBy("_k").agg(F.min(F.struct(d2.alias("d"), F.col(rid).alias("i"), F.col(rx).alias("x"), F.col(ry).alias("y"))).alias("_b"))
    points = left.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(_spot(key, x, y).alias("_k"), x, y).distinct()
    places = checkpointed(right.groupBy(rx, ry).agg(F.min(rid).alias(rid)))
    ends = places.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{c}") for c in (rx, ry) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    n = ends["n"]
    if n <= COMPARED:
        return _with_nearest(left, best(points.join(F.broadcast(places))), right, _spot(key, x, y), rid, rx, ry)
    wide, high = float(ends[f"hi{rx}"] - ends[f"lo{rx}"]), float(ends[f"hi{ry}"] - ends[f"lo{ry}"])
    even = 2 * max((wide * high / n) ** 0.5, max(wide, high) / n) or 1.0  # also for points on one line or at one place
    cell = even if cell is None else min(cell, even)
    for _ in range(FINER):
        if _met(points, places, cell, x, y, rx, ry) <= MET:
            break
        cell /= 4
    side = places.withColumn("_gx", _cell(rx, cell)).withColumn("_gy", _cell(ry, cell))
    around = F.sequence(F.lit(-1), F.lit(1))
    probe = points.withColumn("_gx", F.explode(F.transform(around, lambda k: _cell(x, cell) + k))).withColumn("_gy", F.explode(F.transform(around, lambda k: _cell(y, cell) + k)))
    found = checkpointed(best(probe.join(side.hint("merge"), ["_gx", "_gy"])).where(F.col("_b.d") <= cell * cell))
    open_ = checkpointed(points.join(found.select("_k").hint("merge"), "_k", "left_anti"))
    if open_.limit(1).count():
        cells = [checkpointed(side.select("_gx", "_gy").distinct())]
        low, high = [int(ends[f"lo{c}"] // cell) for c in (rx, ry)], [int(ends[f"hi{c}"] // cell) for c in (rx, ry)]
        while any((b >> 2 * (len(cells) - 1)) - (a >> 2 * (len(cells) - 1)) > 3 for a, b in zip(low, high, strict=True)):
            cells.append(cells[-1].select(F.shiftright("_gx", 2).alias("_gx"), F.shiftright("_gy", 2).alias("_gy")).distinct())
        top = cells[-1].collect()  # at most 16
        near = open_.select("*", F.inline(F.array(*[F.struct(F.lit(r["_gx"]).cast("long").alias("_gx"), F.lit(r["_gy"]).cast("long").alias("_gy")) for r in top])))
        for level in range(len(cells) - 1, -1, -1):
            if level < len(cells) - 1:
                child = cells[level].select(F.col("_gx").alias("_cx"), F.col("_gy").alias("_cy"), F.shiftright("_gx", 2).alias("_gx"), F.shiftright("_gy", 2).alias("_gy"))
                near = near.join(child, ["_gx", "_gy"]).select("_k", x, y, F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy"))
            size = cell * 4**level
            gap, span = [], []
            for c, g in ((x, "_gx"), (y, "_gy")):
                a, b = F.col(g) * size - F.col(c), F.col(c) - (F.col(g) + 1) * size  # to the near and the far edge; rounding is allowed for below
                gap.append(F.greatest(a, b, F.lit(0.0)))
                span.append(F.greatest(F.abs(a), F.abs(b)))
            near = near.withColumn("_lo", gap[0] * gap[0] + gap[1] * gap[1]).withColumn("_hi", span[0] * span[0] + span[1] * span[1])
            near = near.withColumn("_ub", F.min("_hi").over(Window.partitionBy("_k"))).where(F.col("_lo") <= F.col("_ub") * (1 + 1e-9)).select("_k", x, y, "_gx", "_gy")
        found = found.unionByName(best(near.join(side.hint("merge"), ["_gx", "_gy"])))
    return _with_nearest(left, found, right, _spot(key, x, y), rid, rx, ry)


def _with_nearest(left: DataFrame, found: DataFrame, right: DataFrame, spot: Column, rid: str, rx: str, ry: str) -> DataFrame:
    """``left`` with the row of ``right`` that ``found`` (_k, _b) names for the ``spot``, and its squared distance."""
    found = found.select("_k", F.col("_b.d").alias("dist2"), F.col("_b.i").alias("_i"), F.col("_b.x").alias("_px"), F.col("_b.y").alias("_py"))
    if set(right.columns) == {rid, rx, ry}:
        near = {rid: "_i", rx: "_px", ry: "_py"}
        found = found.select("_k", F.struct(*[F.col(near[c]).alias(c) for c in right.columns]).alias("near"), "dist2")
    else:
        rows = right.groupBy(F.col(rid).alias("_i"), F.col(rx).alias("_px"), F.col(ry).alias("_py")).agg(F.first(F.struct(*right.columns)).alias("near"))
        same = F.col("a._i").eqNullSafe(F.col("b._i")) & (F.col("a._px") == F.col("b._px")) & (F.col("a._py") == F.col("b._py"))
        found = found.alias("a").join(rows.alias("b").hint("merge"), same).select("a._k", "near", "dist2")
    return left.withColumn("_k", spot).join(found.hint("merge"), "_k", "left").drop("_k")


def _met(points: DataFrame, places: DataFrame, cell: float, x: str, y: str, rx: str, ry: str) -> float:
    """How many places a point has in its own cell, on average."""
    count = lambda df, a, b, name: df.groupBy(_cell(a, cell).alias("_gx"), _cell(b, cell).alias("_gy")).agg(F.count("*").alias(name))
    met = count(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")), "_x", "_y", "_l").join(count(places, rx, ry, "_r").hint("merge"), ["_gx", "_gy"], "left")
    return met.agg(F.coalesce(F.try_divide(F.sum(F.col("_l") * F.coalesce("_r", F.lit(0))), F.sum("_l")), F.lit(0.0))).first()[0]


def label_inside(points: DataFrame, polygons: DataFrame, key: str, pid: str) -> DataFrame:
    """key with burned int: strictly inside any polygon (pid, ring, or parts with holes where there is such a column).

    Boxes are compared first.  A counted small table of polygons is broadcast; a
    larger one is met through the grid cells of its boxes.
    """
    from ..functions.geometry import inside

    x, y, held = F.col("x"), F.col("y"), "ring"
    within = inside(F.col("ring"), x, y)
    if "parts" in polygons.columns:
        held = "parts"
        within = F.exists("parts", lambda p: inside(p[0], x, y) & ~F.exists(F.slice(p, 2, F.size(p)), lambda hole: inside(hole, x, y)))
        polygons = polygons.withColumn("ring", F.flatten(F.flatten("parts")))
    points = points.select(_spot(key).alias("_k"), F.col(key).alias(key), "x", "y")
    boxed = polygons.select(pid, held, *[f(F.col(f"ring.{a}")).alias(f"{name}{a}") for name, f in (("lo", F.array_min), ("hi", F.array_max)) for a in ("x", "y")])
    in_box = (x >= F.col("lox")) & (x <= F.col("hix")) & (y >= F.col("loy")) & (y <= F.col("hiy"))
    sizes = boxed.agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))).alias("mean"), F.max(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))).alias("most")).first()
    if sizes["n"] <= SMALL:
        hit = points.join(F.broadcast(boxed), in_box & within, "left_semi").select("_k")
    else:
        cell = max(sizes["mean"] or 0.0, (sizes["most"] or 0.0) / 1000) or 1.0  # a box covers a million cells at most
        cover = lambda a: F.explode(F.sequence(_cell(f"lo{a}", cell), _cell(f"hi{a}", cell)))
        dealt = boxed.withColumn("_gx", cover("x")).withColumn("_gy", cover("y"))
        met = points.withColumn("_gx", _cell("x", cell)).withColumn("_gy", _cell("y", cell)).join(dealt, ["_gx", "_gy"])
        hit = met.where(in_box & within).select("_k")
    return points.join(hit.distinct().select("_k", F.lit(1).alias("burned")), "_k", "left").select(key, F.coalesce("burned", F.lit(0)).alias("burned"))


def sample_raster(points: DataFrame, pixels: DataFrame, x0: float, y0: float, res: float, rows: int, cols: int, clamp: bool = False) -> DataFrame:
    """``points`` with v of the pixel under them; outside the extent null, or the edge pixel with ``clamp``.

    The raster meets each place that has points once, in tasks of a fixed number of
    pixels; very many points may share a place, as at the edge with ``clamp``.
    """
    row, col = F.floor((y0 - F.col("y")) / res).cast("long"), F.floor((F.col("x") - x0) / res).cast("long")
    if clamp:
        row, col = F.least(F.greatest(row, F.lit(0)), F.lit(rows - 1)), F.least(F.greatest(col, F.lit(0)), F.lit(cols - 1))
    at = points.withColumn("row", row).withColumn("col", col)
    places, raster = dealt(at.select("row", "col").distinct(), pixels, keys=["row", "col"])
    met = checkpointed(raster.join(places.hint("merge"), ["row", "col"]))
    return at.join(met.hint("merge"), ["row", "col"], "left")


def dedup_by_cell(df: DataFrame, x: str, y: str, tolerance: float, area: str, tie: str) -> DataFrame:
    """The largest row of each snapped grid cell (ties: the smallest ``tie``)."""
    from ..functions.scalars import grid_snap

    rest = F.struct(*[F.col(c) for c in df.columns])
    g = df.groupBy(grid_snap(x, tolerance).alias("_gx"), grid_snap(y, tolerance).alias("_gy"))
    return g.agg(F.max_by(rest, F.struct(F.col(area), -F.col(tie))).alias("r")).select("r.*")
