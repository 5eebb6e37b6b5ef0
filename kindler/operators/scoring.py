"""Group scores, composite and class."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import row_mean
from ..session import checkpointed
from ..session import spread as dealt
from .stats import percentile_ranks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library


def eligibility(df: DataFrame, features: list[str], most_null: float = 0.5) -> dict[str, str]:
    """Reason for each feature that cannot be scored: all-NULL, high-NULL (more than ``most_null``) or zero-variance. One pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(f).alias(f"c{i}") for i, f in enumerate(features)], *[(F.min(f) == F.max(f)).alias(f"k{i}") for i, f in enumerate(features)]).first()
    out = {}
    for i, f in enumerate(features):
        null = 1 - row[f"c{i}"] / row["n"] if row["n"] else 1.0
        if null == 1.0:
            out[f] = "all-NULL"
        elif null > most_null:
            out[f] = "high-NULL"
        elif row[f"k{i}"]:
            out[f] = "zero-variance"
    return out


def group_score(df: DataFrame, features: dict[str, str], out: str) -> DataFrame:
    """``df`` with the mean of its eligible features' percentile ranks; ``features``: direction by column. Fails if none is eligible."""
    present = [f for f in features if f in df.columns]
    bad = eligibility(df, present) if present else {}
    good = [f for f in present if f not in bad]
    if not good:
        raise ValueError(f"no eligible features for {out}: {bad or 'none present'}")
    d = percentile_ranks(df, {f: features[f] for f in good}, {f: f"_p_{f}" for f in good})
    return d.withColumn(out, row_mean(*[f"_p_{f}" for f in good])).drop(*[f"_p_{f}" for f in good])


def composite(df: DataFrame, weights: dict[str, float], out: str = "composite_score") -> DataFrame:
    """Weighted sum of score columns."""
    return df.withColumn(out, sum((F.col(c) * float(w) for c, w in weights.items()), F.lit(0.0)))


def group_scores(df: DataFrame, groups: dict[str, dict[str, str]]) -> DataFrame:
    """``group_score`` of several groups (features by output column) with one check and one ranking of all their features."""
    present = sorted({f for features in groups.values() for f in features if f in df.columns})
    bad = eligibility(df, present) if present else {}
    good = {out: [f for f in features if f in present and f not in bad] for out, features in groups.items()}
    for out, own in good.items():
        if not own:
            raise ValueError(f"no eligible features for {out}: {bad or 'none present'}")
    ways = {(f, groups[out][f]): f"_p{i}" for i, (out, f) in enumerate((out, f) for out, own in good.items() for f in own)}
    copies = df.withColumns({name: F.col(f) for (f, _), name in ways.items()})
    d = percentile_ranks(copies, {name: way for (_, way), name in ways.items()}, {name: f"{name}r" for name in ways.values()})
    d = d.withColumns({out: row_mean(*[f"{ways[f, groups[out][f]]}r" for f in own]) for out, own in good.items()})
    return d.select(*df.columns, *good)


def baseline(df: DataFrame, distance: str, out: str = "baseline_score") -> DataFrame:
    """Percentile rank of 1 / (distance + 1) in the population at hand, clipped to its 1st and 99th percentile; 0.5 for a single row."""
    from .stats import percentile_rank

    return percentile_rank(df.withColumn("_v", 1.0 / (F.col(distance) + 1.0)), "_v", out).drop("_v")


def weight_draws(weights: dict[str, float], rounds: int = 500, spread: float = 0.05, seed: int = 42) -> list[list[float]]:
    """Weights with each one moved by up to ``spread`` of itself, scaled to one, for every round."""
    import numpy as np

    r = np.random.RandomState(seed)
    base = np.array(list(weights.values()))
    out = []
    for _ in range(rounds):
        w = base * (1 + r.uniform(-spread, spread, size=len(base)))
        out.append((w / w.sum()).tolist())
    return out


def weight_stability(df: DataFrame, key: str, weights: dict[str, float], rounds: int = 500, spread: float = 0.05, seed: int = 42, top: float = 0.10) -> DataFrame:
    """key, stability: the share of rounds in which a row of the unperturbed top ``top`` stays in the top.

    Each round needs only its cut-off score, which histograms of all rounds narrow
    down: a pass over the rows counts each round's scores in equal steps between
    its bounds, and the step that holds the cut-off is divided again, until few
    different scores are left in it.  Tasks send counts, as many as rounds times
    steps, however many rows they have.  Ties at a cut-off are won by rows above it
    and then by the smallest key in the base ranking.
    """
    from .stats import top_fraction

    cols = list(weights)
    n = df.count()
    most = max(1, -int(-n * top // 1))
    base = top_fraction(composite(df, weights, "_s"), "_s", key, top).select(key, *cols)
    draws = weight_draws(weights, rounds, spread, seed)
    scores = checkpointed(dealt(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), 20_000))  # every pass computes all rounds of a row
    bars = [[*ws, cut - 1e-12] for ws, cut in zip(draws, _cuts(scores, cols, draws, n, most), strict=True)]
    base = dealt(checkpointed(base)).withColumn("_k", F.size(F.filter(_constant(bars), lambda d: _score(cols, d) >= d[len(cols)])))
    return base.select(key, (F.col("_k") / rounds).alias("stability"))


def _constant(rows: list[list[float]]) -> Column:
    """One constant array: a sum of hundreds of terms would be too deep to compile."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"double('{float(x)!r}')" for x in r) + ")" for r in rows) + ")")


def _score(cols: list[str], d: Column) -> Column:
    return sum((F.col(c) * d[i] for i, c in enumerate(cols)), F.lit(0.0))


#: Steps of a round's histogram; different scores of a round that are ranked at last.
STEPS, LEFT = 256, 512


def _totals(columns: list, draws):
    """Weighted sums, a row for each round, added up in the order of the columns."""
    total = 0.0
    for c, w in zip(columns, draws.T, strict=True):
        total = total + w[:, None] * c[None, :]
    return total


def _chunks(batches, cols: list[str]):
    """Columns of 1,024 rows at most; rows with a missing score are left out."""
    import numpy as np

    for b in batches:
        x = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
        good = ~np.isnan(np.stack(x)).any(axis=0)
        for at in range(0, int(good.sum()), 1024):
            yield [c[good][at : at + 1024] for c in x]


def _cuts(df: DataFrame, cols: list[str], draws: list[list[float]], n: int, most: int) -> list[float]:
    """The ``most``-th highest weighted sum of each draw."""
    import numpy as np
    import pyarrow as pa

    rounds = len(draws)
    if not n:
        return [0.0] * rounds
    w = np.array(draws)
    ends = df.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (("a", F.min), ("b", F.max))]).first()
    sides = np.array([[ends[f"a{i}"], ends[f"b{i}"]] for i in range(len(cols))], float)
    if np.isnan(sides).any():
        return [0.0] * rounds
    both = w[:, :, None] * sides[None, :, :]
    low, high = both.min(axis=2).sum(axis=1), both.max(axis=2).sum(axis=1)
    slack = 1e-9 * (1 + np.abs(low) + np.abs(high))
    low, high = low - slack, high + slack
    rank = np.full(rounds, most)  # from the top of the interval

    def counted(low, high):
        def run(batches):
            total = np.zeros((rounds, STEPS + 2), np.int64)
            for x in _chunks(batches, cols):
                s = _totals(x, w)
                with np.errstate(divide="ignore", invalid="ignore"):
                    step = np.clip(np.floor((s - low[:, None]) / (high - low)[:, None] * STEPS), 0, STEPS - 1).astype(np.int64)
                step[s < low[:, None]], step[s > high[:, None]] = STEPS, STEPS + 1
                step += (np.arange(rounds) * (STEPS + 2))[:, None]
                total += np.bincount(step.ravel(), minlength=total.size).reshape(total.shape)
            yield pa.record_batch([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(list(total), pa.list_(pa.int64()))], names=["r", "n"])

        return run

    for _ in range(12):
        per = df.mapInArrow(counted(low, high), "r int, n array<long>").select("r", F.posexplode("n").alias("i", "c")).where("c > 0").groupBy("r", "i").agg(F.sum("c").alias("c")).collect()  # rounds x steps
        total = np.zeros((rounds, STEPS + 2), np.int64)
        for r in per:
            total[r["r"], r["i"]] = r["c"]
        above = np.cumsum(total[:, STEPS - 1 :: -1], axis=1)  # from the highest step down
        at = np.minimum((above < rank[:, None]).sum(axis=1), STEPS - 1)
        own, step = np.arange(rounds), STEPS - 1 - at
        held = total[own, step]
        wide = (high - low) / STEPS
        # bounds with room for rounding; the rank is counted anew among what lies above the new upper bound
        new_low, new_high = np.maximum(low, low + step * wide - 1e-12), np.minimum(high, low + (step + 1) * wide + 1e-12)
        if held.max() <= LEFT or (new_high - new_low <= 4e-12).all():
            low, high = new_low, new_high
            break
        over = df.mapInArrow(_over(cols, w, new_high, rounds), "r int, c long").groupBy("r").agg(F.sum("c").alias("c")).collect()
        beyond = np.zeros(rounds, np.int64)
        for r in over:
            beyond[r["r"]] = r["c"]
        low, high, rank = new_low, new_high, most - beyond

    def values(batches):
        found: dict = {}
        for x in _chunks(batches, cols):
            s = _totals(x, w)
            for r, c in zip(*np.nonzero((s >= low[:, None]) & (s <= high[:, None])), strict=True):
                found[int(r), float(s[r, c])] = found.get((int(r), float(s[r, c])), 0) + 1
        rows = [(r, v, k) for (r, v), k in found.items()]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], names=["r", "v", "k"])

    beyond = {r["r"]: r["c"] for r in df.mapInArrow(_over(cols, w, high, rounds), "r int, c long").groupBy("r").agg(F.sum("c").alias("c")).collect()}
    left: dict = {}
    for r in df.mapInArrow(values, "r int, v double, k long").groupBy("r", "v").agg(F.sum("k").alias("k")).collect():  # few for each round
        left.setdefault(r["r"], []).append((r["v"], r["k"]))
    out = []
    for r in range(rounds):
        seen, cut = beyond.get(r, 0), float(low[r])
        for v, k in sorted(left.get(r, []), reverse=True):
            seen, cut = seen + k, v
            if seen >= most:
                break
        out.append(cut)
    return out


def _over(cols: list[str], w, bound, rounds: int):
    """Counts of scores above each round's bound."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(rounds, np.int64)
        for x in _chunks(batches, cols):
            total += (_totals(x, w) > bound[:, None]).sum(axis=1)
        yield pa.record_batch([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(total)], names=["r", "c"])

    return run


def scoring_run(features: DataFrame, key: str, groups: dict[str, dict[str, str]], weights: dict[str, float], path: str, pair: tuple[str, str], least_rows: int = 80_000, classes: int = 5) -> tuple[DataFrame, DataFrame]:
    """(scores as written to ``path``, checks): features to group scores, composite, class and the checks that must hold before anything is written.

    ``groups`` has the features and directions of each group score, ``weights`` the
    groups' weights.  Features that are missing, empty, mostly null or constant are
    left out; the weight of a group without any left is shared out among the
    others.  A failed check raises before the table is replaced, and names what
    failed.
    """
    from ..functions.scalars import redistributed
    from .quality import score_checks
    from .stats import quantile_class

    wanted = sorted({f for own in groups.values() for f in own})
    given = [f for f in wanted if f in features.columns]
    bad = eligibility(features, given) if given else {}
    alive = {out: own for out, own in groups.items() if any(f in given and f not in bad for f in own)}
    if not alive:
        raise ValueError(f"no group has an eligible feature: {bad or 'none present'}")
    shares = redistributed(weights, list(alive))
    scored = quantile_class(composite(group_scores(features.select(key, *given), alive), shares), "composite_score", classes=classes)
    scored = checkpointed(scored.select(key, *alive, "composite_score", "risk_class"))
    checks = checkpointed(score_checks(scored, ["composite_score", *alive], "risk_class", pair, least_rows=least_rows, classes=classes))
    failed = [f"{r['check']} of {r['subject']}: {r['value']}" for r in checks.where("not ok").collect()]  # a row for each check
    if failed:
        raise ValueError(f"nothing written, {len(failed)} checks failed: {'; '.join(failed)}")
    scored.write.mode("overwrite").parquet(path)
    return features.sparkSession.read.parquet(path), checks
