"""Random numbers from hashes: reproducible whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """(0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(key, 11).cast("double") + 0.5) / float(2**53)


def poisson(mean: Column, key: Column, inverted_up_to: int = 10) -> Column:
    """Poisson draw of a whole ``mean``: by inversion when small, by a rounded normal beyond."""
    u = uniform(key)
    out = F.lit(None).cast("double")
    for m in range(inverted_up_to, -1, -1):
        total, term, edges = 0.0, math.exp(-m), []
        for k in range(4 * m + 12):
            total += term
            edges.append(total)
            term *= m / (k + 1)
        out = F.when(mean == m, F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < u)).cast("double")).otherwise(out)
    # a normal by Box and Muller on two hashes
    z = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(F.xxhash64(key, F.lit(7))))
    return F.coalesce(out, F.greatest(F.round(mean + F.sqrt(mean.cast("double")) * z), F.lit(0.0)))
