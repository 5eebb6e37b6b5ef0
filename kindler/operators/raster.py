"""Raster operators on pixel tables (row, col, v).

Neighbourhoods are read by equi-joins on shifted keys or by windows along one
axis; a window's partition is one line of pixels, never the raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, dealt


def mosaic(tiles: DataFrame, priority: str, window: tuple[int, int, int, int]) -> DataFrame:
    """One pixel table from overlapping ones: the highest priority with a value wins; ``window`` is row0, row1, col0, col1 (inclusive)."""
    r0, r1, c0, c1 = window
    inside = tiles.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1) & F.col("v").isNotNull())
    (inside,) = dealt(inside, keys=["row", "col"])
    return inside.groupBy("row", "col").agg(F.max_by("v", priority).alias("v"))


def resample(pixels: DataFrame, target: DataFrame, how: str = "nearest") -> DataFrame:
    """``target`` (trow, tcol, y, x in source pixel units, pixel centres at whole numbers) with v by nearest or bilinear sampling; outside: null."""
    if how == "nearest":
        t = target.withColumn("row", F.floor(F.col("y") + 0.5).cast("long")).withColumn("col", F.floor(F.col("x") + 0.5).cast("long"))
        return t.join(pixels.hint("merge"), ["row", "col"], "left").select("trow", "tcol", "v")
    # a target needs the pixel before it in any case, so what lies beyond that pixel travels with it
    line = Window.partitionBy("row").orderBy("col")
    pair = pixels.select("row", "col", F.col("v").alias("_00"), F.when(F.lead("col").over(line) == F.col("col") + 1, F.lead("v").over(line)).alias("_01"))
    below = pair.select((F.col("row") - 1).alias("row"), "col", F.col("_00").alias("_10"), F.col("_01").alias("_11"))
    four = pair.join(below.hint("merge"), ["row", "col"], "left")
    t = target.withColumns({"row": F.floor("y").cast("long"), "col": F.floor("x").cast("long"), "fy": F.col("y") - F.floor("y"), "fx": F.col("x") - F.floor("x")})
    weight = {f"_{a}{b}": (F.col("fy") if a else 1 - F.col("fy")) * (F.col("fx") if b else 1 - F.col("fx")) for a in (0, 1) for b in (0, 1)}
    v = sum((F.when(w > 0, w * F.col(c)).otherwise(0.0) for c, w in weight.items()), F.lit(0.0))
    return t.join(four.hint("merge"), ["row", "col"], "left").select("trow", "tcol", v.alias("v"))


def slope_aspect(pixels: DataFrame, cell: float) -> DataFrame:
    """Horn's 3x3 slope and aspect in degrees; a missing neighbour (edge or gap) counts as the pixel towards it, a flat pixel has aspect 270."""
    lines = {axis: Window.partitionBy(other).orderBy(axis) for axis, other in (("col", "row"), ("row", "col"))}

    def beside(f, axis: str, step: int, c: str):
        """``c`` of the next pixel along ``axis``, if it is really next."""
        w = lines[axis]
        return F.when(f(axis).over(w) == F.col(axis) + step, f(c).over(w))

    d = pixels.select("row", "col", "v", F.coalesce(beside(F.lag, "col", -1, "v"), "v").alias("w"), F.coalesce(beside(F.lead, "col", 1, "v"), "v").alias("e"))
    d = d.select("row", "col", "v", "w", "e", *[F.coalesce(beside(F.lag, "row", -1, c), F.col(c)).alias(f"n{c}") for c in ("w", "v", "e")], *[F.coalesce(beside(F.lead, "row", 1, c), F.col(c)).alias(f"s{c}") for c in ("w", "v", "e")])
    dzdx = ((F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))) / (8 * cell)
    dzdy = ((F.col("sw") + 2 * F.col("sv") + F.col("se")) - (F.col("nw") + 2 * F.col("nv") + F.col("ne"))) / (8 * cell)
    d = d.select("row", "col", dzdx.alias("dzdx"), dzdy.alias("dzdy"))
    slope = F.degrees(F.atan(F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))))
    aspect = F.when((F.col("dzdx") == 0) & (F.col("dzdy") == 0), 270.0).otherwise(F.pmod(450.0 - F.degrees(F.atan2("dzdy", -F.col("dzdx"))), F.lit(360.0)))
    return d.select("row", "col", slope.alias("slope_deg"), aspect.alias("aspect_deg"))


def focal_means(pixels: DataFrame, k: int, rows: int, cols: int, values: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """row, col, ``keep`` and m_<value> of each pixel: means over the pixels there are in its (2k+1)^2 square, with mirrored edges.

    Two one-dimensional passes over distances, not rows, for all values at once.
    The first one also gives sums for the places of a gap that lie within reach of
    a pixel along its line, so gaps are neither counted nor jumped; a raster without
    gaps has none.  Lines are cut into blocks, and what a neighbouring block reaches
    is copied into it, so no window holds a line, however long.
    """
    block = max(512, 4 * k)
    sums = [f"{f}_{v}" for v in values for f in "sc"]

    def passed(df: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        place = lambda at, own: F.struct(at.cast("long").alias("_at"), F.lit(own).alias("_own"))
        a = F.col(axis)
        places = F.array_compact(F.array(place(a, True), F.when(a < k, place(-1 - a, False)), F.when(a >= n - k, place(2 * n - 1 - a, False))))
        df = df.select(other, "_here", *keep, *sums, F.inline(places)).withColumnRenamed("_at", axis)
        df = df.withColumn("_b", F.explode(F.sequence(F.floor((a - k) / block), F.floor((a + k) / block))))
        w = Window.partitionBy(other, "_b").orderBy(axis).rangeBetween(-k, k)
        own = F.col("_own") & (F.col("_b") == F.floor(a / block))
        return df.select("row", "col", "_here", *keep, own.alias("_own"), *[F.sum(c).over(w).alias(c) for c in sums]).where("_own").drop("_own")

    d = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(True).alias("_here"), *keep, *[c for v in values for c in (F.col(v).cast("double").alias(f"s_{v}"), F.col(v).isNotNull().cast("long").alias(f"c_{v}"))])
    line = Window.partitionBy("row").orderBy("col")
    before, after = F.lag("col").over(line), F.lead("col").over(line)
    # each place of a gap once: from the pixel before it, else from the one after it
    ends = d.select("row", "col", F.greatest(F.coalesce(before + k + 1, F.lit(0)), F.col("col") - k).alias("a"), F.least(F.coalesce(after, F.lit(cols)) - 1, F.col("col") + k).alias("b"))
    beside = F.concat(F.when(F.col("a") < F.col("col"), F.sequence("a", F.col("col") - 1)).otherwise(F.array()), F.when(F.col("b") > F.col("col"), F.sequence(F.col("col") + 1, F.col("b"))).otherwise(F.array()))
    gaps = ends.where("a < col or b > col").select("row", F.explode(beside).alias("col")).withColumn("_here", F.lit(False)).withColumns({c: F.lit(0 if c[0] == "c" else None).cast("long" if c[0] == "c" else "double") for c in sums})
    down = passed(d.unionByName(gaps, allowMissingColumns=True), "row", "col", rows)
    return passed(down, "col", "row", cols).where("_here").select("row", "col", *keep, *[F.try_divide(f"s_{v}", f"c_{v}").alias(f"m_{v}") for v in values])


def focal_mean(pixels: DataFrame, k: int, rows: int, cols: int, value: str = "v") -> DataFrame:
    """row, col, m of each pixel: the focal mean of one value."""
    return focal_means(pixels, k, rows, cols, [value]).withColumnRenamed(f"m_{value}", "m")


def position_ruggedness(pixels: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """row, col, m = focal mean, tpi = z - mean and tri = sqrt(max(0, E[z^2] - 2 z E[z] + z^2)); for the means of tpi and tri, nulls are filled with the global mean."""
    mean = pixels.agg(F.avg("v").alias("m")).first()["m"]
    filled = pixels.select("row", "col", "v", F.col("v").alias("z"), F.coalesce(F.col("v"), F.lit(mean)).alias("f")).withColumn("sq", F.col("f") * F.col("f"))
    d, z = focal_means(filled, k, rows, cols, ["v", "f", "sq"], ("z",)), F.col("z")
    return d.select("row", "col", F.col("m_v").alias("m"), (z - F.col("m_f")).alias("tpi"), F.sqrt(F.greatest(F.lit(0.0), F.col("m_sq") - 2 * z * F.col("m_f") + z * z)).alias("tri"))


def fraction(pixels: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """Focal share of pixels of value 1; 255 counts as 0."""
    ones = pixels.select("row", "col", F.when(F.col("v") == 1, 1.0).otherwise(0.0).alias("v"))
    return focal_mean(ones, k, rows, cols).withColumn("m", F.least(F.greatest("m", F.lit(0.0)), F.lit(1.0)))


def class_distance(points: DataFrame, pixels: DataFrame, wanted: int, key: str, dy: float, dx: float) -> DataFrame:
    """key, dist: metres from the point's pixel (row, col) to the nearest pixel of the class; pixels may be oblong."""
    from .spatial import nearest

    targets = pixels.where(F.col("v") == wanted).select((F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("pid"), (F.col("row") * dy).alias("ry"), (F.col("col") * dx).alias("rx"))
    p = points.select(key, (F.col("row") * dy).alias("y"), (F.col("col") * dx).alias("x"))
    return nearest(p, targets, key, "pid").select(key, F.sqrt("dist2").alias("dist"))


def components(pixels: DataFrame, cols: int, tile: int = 256) -> DataFrame:
    """row, col, label of pixels of value 1: the smallest row * cols + col of their 4-connected patch.

    Tiles are labelled on their own, those of a block of about 512 x 512 pixels in
    one step; labels that touch across a seam are joined by alternating star joins
    over the seam graph.
    """
    import numpy as np
    import pandas as pd

    block = max(1, 512 // tile) * tile

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        label = r * cols + c
        last = np.iinfo(np.int64).max
        i, k = r - r.min() // block * block, c - c.min() // block * block
        i, k = i + i // tile + 1, k + k // tile + 1  # a line of nothing around each tile
        grid = np.full((i.max() + 2, k.max() + 2), last)
        grid[i, k] = label
        on = grid < last
        while True:  # minima of whole runs along the lines, then down the columns, until nothing moves
            before = grid
            for _ in range(2):
                grid = _run_minima(grid, on).T
                on = on.T
            if (grid == before).all():
                break
        return pd.DataFrame({"row": r, "col": c, "label": grid[i, k]})

    on = pixels.where("v = 1").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    blocks = on.withColumns({"_i": F.floor(F.col("row") / block), "_k": F.floor(F.col("col") / block)})
    (blocks,) = dealt(blocks, keys=["_i", "_k"])
    local = checkpointed(blocks.groupBy("_i", "_k").applyInPandas(own, "row long, col long, label long"))
    edge = local.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
    a = edge.select("row", "col", F.col("label").alias("a"))
    steps = F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c")))
    b = edge.select("row", "col", F.col("label").alias("b"), F.explode(steps).alias("s")).select((F.col("row") - F.col("s.r")).alias("row"), (F.col("col") - F.col("s.c")).alias("col"), "b")
    a, b = dealt(a, b, keys=["row", "col"])
    seams = checkpointed(a.join(b.hint("merge"), ["row", "col"]).where("a <> b").select("a", "b").distinct())
    names = checkpointed(connected(seams).select(F.col("node").alias("label"), F.col("component").alias("low")))
    local, names = dealt(local, names, keys=["label"])  # a tile's label has the tile's pixels at most
    return local.join(names.hint("merge"), "label", "left").select("row", "col", F.coalesce("low", "label").alias("label"))


def _run_minima(grid, on):
    """``grid`` with every run of ``on`` along a line replaced by its minimum."""
    import numpy as np

    flat, mask = grid.ravel(), on.ravel()  # the frame keeps lines apart
    start = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0) != 0)
    if not len(start):
        return grid
    low = np.minimum.reduceat(flat, start)
    out = flat.copy()
    out[start[0] :] = np.repeat(low, np.diff(np.append(start, len(flat))))
    return out.reshape(grid.shape)


def connected(links: DataFrame) -> DataFrame:
    """(node, component = smallest node) of links (a, b) by alternating large-star and small-star; rounds grow with the logarithm of the longest chain."""
    e = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now


def continuity(points: DataFrame, labels: DataFrame, key: str, k: int) -> DataFrame:
    """key, share: vegetation pixels of the point's own patch among all in the disc dr^2 + dc^2 <= k^2; 0 off vegetation.

    ``points`` has key, row, col; ``labels`` the components of vegetation.  A disc
    is an interval on each of 2k+1 lines.  Pixels are numbered along their line,
    and along their line and patch; the number of pixels in an interval is the
    difference of the numbers at its two ends, so a point makes 4k+2 rows, whatever
    the area of its disc.
    """
    centre = labels.join(points.select("row", "col").distinct().hint("merge"), ["row", "col"]).select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col("label").alias("own"))
    dr = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    lines = centre.select("_r", "_c", "own", dr.alias("_d")).withColumn("_h", F.floor(F.sqrt(F.lit(k * k) - F.col("_d") * F.col("_d"))))
    # the first end counts the pixels before it, the second one those up to it
    end = lambda sign: F.struct((F.col("_c") + sign * F.col("_h")).alias("col"), F.lit(sign).alias("sign"))
    ends = lines.select("_r", "_c", "own", (F.col("_r") + F.col("_d")).alias("row"), F.inline(F.array(end(-1), end(1))))
    wanted = ends.select("row").distinct()  # lines that no disc meets are not numbered
    pixels = labels.join(wanted.hint("merge"), "row", "left_semi").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("label").alias("own"), F.lit(0).alias("sign"))
    both = ends.unionByName(pixels, allowMissingColumns=True)
    seen = lambda *by: F.sum((F.col("sign") == 0).cast("long")).over(Window.partitionBy(*by).orderBy("col", "sign"))
    numbers = both.select("_r", "_c", "own", "sign", seen("row").alias("_all"), seen("row", "own").alias("_own")).where("sign <> 0")
    share = numbers.groupBy("_r", "_c").agg((F.sum(F.col("sign") * F.col("_own")) / F.sum(F.col("sign") * F.col("_all"))).alias("share"))
    found = points.select(key, F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c")).join(share, ["_r", "_c"], "left")
    return found.select(key, F.coalesce("share", F.lit(0.0)).alias("share"))
