"""Ranks, bins, AUC and curves from frequency tables.

A global rank needs no global sort of the rows: equal values are counted first,
the counts are summed within value buckets, and bucket totals give the offsets.
Buckets are cut at approximate quantiles (any cuts give right sums); their number
follows the number of values, from ``LEAST`` to ``MOST``, so no task holds more
than a small share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpointed

LEAST, MOST, PER_BUCKET = 16, 1024, 50_000


#: Shares and steps as short texts: as arrays of literals they would slow down every analysis of the plan.
_SHARES = "cast(split('" + ",".join(str(i / MOST) for i in range(1, MOST)) + "', ',') as array<double>)"
_STEPS = f"transform(sequence(0, {MOST.bit_length() - 1}), i -> shiftright({MOST}, i))"


def _below(edges: str, value: str, than: str = "<") -> Column:
    """How many of the sorted ``edges`` are less than (or ``than``) ``value``, by binary search."""
    return F.expr(f"aggregate({_STEPS}, 0, (a, s) -> if(coalesce(get({edges}, a + s - 1) {than} {value}, false), a + s, a))")


def _edges(df: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, one array of cuts for each of ``values``), sorted and distinct: a row for each group."""
    given = df.select(*by, *[v.cast("double").alias(f"_v{k}") for k, v in values.items()])
    every = given.groupBy(*by).agg(F.expr(f"cast(least(greatest(ceil(count(*) / {PER_BUCKET}), {LEAST}), {MOST}) as int) AS _n"), *[F.expr(f"percentile_approx(`_v{k}`, {_SHARES}, {2 * MOST}) AS `_q{k}`") for k in values])
    thin = "coalesce(array_distinct(transform(sequence(1, _n - 1), i -> element_at(`_q{0}`, cast(i * {1} / _n as int)))), cast(array() as array<double>)) AS `{0}`"
    return every.select(*by, *[F.expr(thin.format(k, MOST)) for k in values])


def _with(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``small``: one row for each group, or one row."""
    return df.join(small, by) if by else df.join(F.broadcast(small))


def bucketed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with ``_b``, a bucket that grows with ``value`` within each group."""
    cuts = _edges(df, {"_e": F.col(value)}, by)
    return _with(df, cuts, by).withColumn("_b", _below("_e", f"cast(`{value}` as double)")).drop("_e")


def running(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``df`` (one row for each by + value) with c_<name>: the sum of <name> up to and with the row, and t_<name>: the group's total.

    A column ``_b`` of ``bucketed`` is used if there is one.
    """
    by = by or []
    order = F.col(value).desc() if descending else F.col(value).asc()
    d = df if "_b" in df.columns else bucketed(df, value, by)
    totals = d.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    key = F.col("_b").desc() if descending else F.col("_b").asc()
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums], *[F.sum(f"_s_{s}").over(group).alias(f"t_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    columns = [c for c in df.columns if c != "_b"]
    d = d.select(*columns, "_b", *[F.sum(s).over(inner).alias(f"_c_{s}") for s in sums])
    d = d.join(F.broadcast(totals) if not by else totals, [*by, "_b"])
    return d.select(*columns, *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"c_{s}") for s in sums], *[f"t_{s}" for s in sums])


def frequencies(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, c_n, t_n) of the values that are not null: count, count up to and with the value, and of the group."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(counts, value, ["n"], by)


def midranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, rank, total): average-tie rank of each distinct value; nulls have none."""
    r = frequencies(df, value, by)
    return r.select(*(by or []), value, "n", (F.col("c_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), F.col("t_n").alias("total"))


def average_rank(df: DataFrame, value: str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    by = by or []
    ranks = midranks(df, value, by).select(*by, value, F.col("rank").alias(out))
    return df.join(ranks, [*by, value], "left")


def percentiles(counted: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p array<double>): linearly interpolated percentiles of ``frequencies``; a row for each group with values."""
    by = by or []
    at = [f"((t_n - 1) * {float(s)!r}D)" for s in shares]
    rows = [f"max(if({f}({k}) >= c_n - n and {f}({k}) < c_n, cast(`{value}` as double), null)) AS {f}{i}" for i, k in enumerate(at) for f in ("floor", "ceil")]
    g = counted.groupBy(*by).agg(F.max("t_n").alias("t_n"), *[F.expr(r) for r in rows]).where("t_n is not null")
    return g.select(*by, F.expr("array(" + ", ".join(f"floor{i} + (ceil{i} - floor{i}) * ({k} - floor({k}))" for i, k in enumerate(at)) + ") AS p"))


def percentile_edges(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Linearly interpolated percentiles of the values that are not null."""
    row = percentiles(frequencies(df, value), value, shares).first()
    return list(row["p"]) if row is not None else []


def clipped_scores(df: DataFrame, value: str, low: float = 1.0, high: float = 99.0, by: list[str] | None = None) -> DataFrame:
    """(by, value, score) of each distinct value: winsorised to [p_low, p_high], ranked with average ties, scaled to [0, 1].

    One value alone scores 0.5, and so does a constant.  The clipped values need
    no second ranking: each tail is one tie whose size is a sum of counts.
    """
    by = by or []
    r = checkpointed(frequencies(df, value, by))  # read three times
    v = F.col(value).cast("double")
    ends = percentiles(r, value, [low / 100, high / 100], by).select(*by, F.col("p")[0].alias("_lo"), F.col("p")[1].alias("_hi"))
    d = _with(r, ends, by)
    tails = d.groupBy(*by).agg(F.sum(F.when(v <= F.col("_lo"), F.col("n")).otherwise(0)).alias("_nlo"), F.sum(F.when(v >= F.col("_hi"), F.col("n")).otherwise(0)).alias("_nhi"))
    d = _with(d, tails, by)
    rank = F.when(F.col("_lo") == F.col("_hi"), (F.col("t_n") + 1) / 2).when(v <= F.col("_lo"), (F.col("_nlo") + 1) / 2).when(v >= F.col("_hi"), F.col("t_n") - F.col("_nhi") + (F.col("_nhi") + 1) / 2)
    rank = rank.otherwise(F.col("c_n") - F.col("n") + (F.col("n") + 1) / 2)
    return d.select(*by, value, F.when(F.col("t_n") == 1, 0.5).otherwise((rank - 1) / (F.col("t_n") - 1)).alias("score"))


def percentile_rank(df: DataFrame, value: str, out: str, low: float = 1.0, high: float = 99.0, direction: str = "positive") -> DataFrame:
    """Winsorise to [p_low, p_high], rank with average ties, scale to [0, 1]; ``negative`` inverts.

    n counts values that are not null, nulls stay null, one value alone is 0.5,
    and so is a constant column.
    """
    score = 1 - F.col("score") if direction == "negative" else F.col("score")
    return df.join(clipped_scores(df, value, low, high).select(value, score.alias(out)), value, "left").select(*df.columns, out)


def percentile_ranks(df: DataFrame, directions: dict[str, str], names: dict[str, str]) -> DataFrame:
    """``percentile_rank`` of several columns in one pass: all values go through one long table, and come back by row.

    ``df`` is computed once, into the shared checkpoint folder.
    """
    d = checkpointed(df.withColumn("_id", F.monotonically_increasing_id()))
    cells = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f).cast("double").alias("_v")) for i, f in enumerate(directions)])
    long = d.select("_id", F.inline(cells)).where("_v is not null")
    scores = long.join(clipped_scores(long, "_v", by=["_f"]), ["_f", "_v"])
    way = {f: 1 - F.col("score") if how == "negative" else F.col("score") for f, how in directions.items()}
    rows = scores.groupBy("_id").agg(*[F.max(F.when(F.col("_f") == i, way[f])).alias(names[f]) for i, f in enumerate(directions)])
    return d.join(checkpointed(rows), "_id", "left").drop("_id")


def quantile_class(df: DataFrame, value: str, out: str = "risk_class", classes: int = 5) -> DataFrame:
    """Right-closed equal-frequency bins 1..classes, lowest value included; fails if quantiles coincide."""
    edges = percentile_edges(df, value, [i / classes for i in range(classes + 1)])
    if edges and len(set(edges)) < len(edges):
        raise ValueError(f"quantiles of {value} coincide: {edges}")
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if edges else F.array().cast("array<double>")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (1 + F.size(F.filter(inner, lambda e: F.col(value) > e))).cast("int")))


def counted(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """(by, score, n, p): rows and positives of each score; rows without a score or label are left out."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))


def ranked_auc(counts: DataFrame, score: str, by: list[str], least: int = 1) -> DataFrame:
    """``auc`` of ``counted`` rows."""
    r = running(counts, score, ["n"], by).withColumn("rank", F.col("c_n") - F.col("n") + (F.col("n") + 1) / 2)
    g = r.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * F.col("rank")).alias("s"))
    neg = F.col("n") - F.col("n_pos")
    area = F.try_divide(F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos").cast("double") * neg)
    return g.select(*by, "n", "n_pos", F.when((F.col("n_pos") >= least) & (neg >= least), area).alias("auc"))


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """(by, n, n_pos, auc): tie-aware area under the ROC curve; null with fewer than ``least`` rows of either class."""
    return ranked_auc(counted(df, label, score, by or []), score, by or [], least)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr at every distinct score, from the highest."""
    counts = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    r = running(counts, score, ["p", "q"], descending=True)
    return r.select(F.col(score).alias("threshold"), F.try_divide(F.col("c_q"), F.col("t_q")).alias("fpr"), F.try_divide(F.col("c_p"), F.col("t_p")).alias("tpr"))


def _number(df: DataFrame, name: str) -> Column:
    """A number that never falls where ``name`` grows: the value itself, or the first bytes of a string."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.conv(F.rpad(F.left(F.hex(name), F.lit(14)), 14, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def ordered_position(df: DataFrame, score: str, tie: str, out: str = "position") -> DataFrame:
    """1-based position by descending score, ties by ascending ``tie`` (a number, date or string); nulls come last.

    Rows are sorted within buckets of scores.  A frequent score is a cut, and a
    cut has buckets of its own, by ``tie``: however many rows share it, no task
    sorts all of them.
    """
    d = df.withColumns({"_v": F.col(score).cast("double"), "_u": _number(df, tie)})
    d = _with(d, _edges(d, {"_es": F.col("_v"), "_et": F.col("_u")}, []), [])
    d = d.withColumn("_b", F.when(F.col("_v").isNotNull(), _below("_es", "_v") + _below("_es", "_v", "<=")).otherwise(-1))
    d = d.withColumn("_t", F.when((F.col("_b") % 2 != 0), _below("_et", "_u")).otherwise(0)).drop("_es", "_et", "_v", "_u")
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc(), "_t").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("_b", "_t").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("_b", "_t").orderBy(F.col(score).desc(), F.col(tie)))
    return d.withColumn("_r", inner).join(sizes, ["_b", "_t"]).withColumn(out, F.col("_before") + F.col("_r")).select(*df.columns, out)


def top_fraction(df: DataFrame, score: str, tie: str, k: float) -> DataFrame:
    """The max(1, ceil(n k)) rows with the highest scores."""
    n = df.count()
    most = max(1, -int(-n * k // 1))
    return ordered_position(df, score, tie).where(F.col("position") <= most)


def lift_at(df: DataFrame, label: str, score: str, tie: str, k: float = 0.10) -> DataFrame:
    """One row: lift, precision of the top fraction over prevalence; null without positives."""
    top = top_fraction(df, score, tie, k).agg(F.avg(F.col(label).cast("double")).alias("precision"))
    return df.agg(F.avg(F.col(label).cast("double")).alias("prevalence")).crossJoin(top).select(F.expr("try_divide(precision, prevalence)").alias("lift"))


def lift_curve(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """position, cumulative hits and rate by descending score."""
    d = ordered_position(df, score, tie).select("position", F.col(label).cast("long").alias("y"))
    r = running(d, "position", ["y"])
    return r.select("position", F.col("c_y").alias("hits"), (F.col("c_y") / F.col("position")).alias("rate"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts on [0, 1] in equal bins, the last one closed on the right; empty bins included."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = df.where(F.col(value).between(0, 1)).groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bootstrap_auc(df: DataFrame, label: str, score: str, by: str, rounds: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, auc, low, high): percentile interval over Poisson(1) resamples of the frequency table.

    The draws of a score follow from a hash of (score, class, round, seed), so the
    interval does not depend on partitioning.  A task takes a bucket of scores and
    keeps three vectors over the rounds: positives, negatives and pairs in order.
    Only these travel, at most ``MOST`` for each group, however many rows and
    distinct scores there are; a scan over a group's buckets adds them up.  Rounds
    without positives or negatives are skipped; a group without any has nulls.
    """
    import pyarrow as pa

    from .resample import bucket_sums, interval

    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col(score).cast("double").alias("v")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    kind = counts.schema[by].dataType.simpleString()
    counts = bucketed(counts, "v", [by])

    def sums(key, t):
        made = bucket_sums(*(t.column(c).to_numpy() for c in ("v", "p", "q")), rounds, seed)
        return pa.table({by: t.column(by).slice(0, 1), "_b": t.column("_b").slice(0, 1), "sums": pa.array([made.ravel()], pa.list_(pa.float64()))})

    def close(key, t):
        t = t.sort_by("_b")
        low, high = interval([x.reshape(3, rounds) for x in t.column("sums").combine_chunks().values.to_numpy().reshape(len(t), -1)], ci)
        return pa.table({by: t.column(by).slice(0, 1), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    vectors = counts.groupBy(by, "_b").applyInArrow(sums, f"`{by}` {kind}, _b int, sums array<double>")
    ends = vectors.groupBy(by).applyInArrow(close, f"`{by}` {kind}, low double, high double")
    return auc(df, label, score, [by]).select(by, "auc").join(ends, by, "left")


def stratified_sample(df: DataFrame, stratum: str, total: int, order: list[str]) -> DataFrame:
    """Of each stratum its share of ``total`` rows, one at least, the first by ``order`` (a draw, then ties).

    The shares follow from the counts.  Rows are first ranked within slices of a
    stratum, and a slice passes on no more than the whole stratum may keep, so no
    task ranks a large stratum.  Slices follow from ``order``, also where a task is
    repeated; rows that repeat all of it share a slice and count as often as they
    occur.
    """
    n = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    every = n.agg(F.sum("_n").alias("_t"))
    n = n.crossJoin(every).select(F.col(stratum).alias("_s"), F.least("_n", F.greatest(F.lit(1), F.round(float(total) * F.col("_n") / F.col("_t")).cast("long"))).alias("_k"), F.ceil(F.col("_n") / PER_BUCKET).cast("int").alias("_m"))
    d = df.join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    slices = d.withColumn("_c", F.pmod(F.xxhash64(*order), "_m"))
    first = slices.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_c").orderBy(*order))).where("_r <= _k")
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).where("_r <= _k")
    return kept.select(*df.columns)
