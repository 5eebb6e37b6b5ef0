"""Resampling by hash draws, all rounds of a bucket of scores at once."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

#: Counts up to which a Poisson draw is found by inversion; beyond, a rounded normal; scores drawn at once.
INVERTED, AT_ONCE = 20, 512
_MASK = 0xFFFFFFFF
#: Multiplier of the 32-bit mix.
FACTOR = 0x45D9F3B


def mix(x):
    """A 32-bit integer hash, of numbers or arrays."""
    for _ in range(2):
        x = x ^ (x >> 16)
        x = (x * FACTOR) & _MASK
    return x ^ (x >> 16)


def round_keys(rounds: int, seed: int) -> np.ndarray:
    return mix(np.arange(rounds, dtype=np.int64) ^ mix(seed))


def value_keys(v: np.ndarray) -> np.ndarray:
    """From the bits of doubles; zero has one sign."""
    bits = (np.asarray(v, float) + 0.0).view(np.uint64)
    return mix((bits & np.uint64(_MASK)).astype(np.int64) ^ mix((bits >> np.uint64(32)).astype(np.int64)))


def poisson_edges(mean: int) -> list[float]:
    """Cumulative shares of 0, 1, 2 ... for a Poisson of ``mean``."""
    total, term, edges = 0.0, math.exp(-mean), []
    for k in range(4 * mean + 12):
        total += term
        edges.append(total)
        term *= mean / (k + 1)
    return edges


_EDGES = {m: np.array(poisson_edges(m)) for m in range(1, INVERTED + 1)}


def draws(count: np.ndarray, keys: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Poisson draws, a row for each count and a column for each round."""
    h = mix(keys[:, None] ^ rounds[None, :])
    u = (h + 0.5) / 2.0**32
    out = np.zeros(u.shape)
    for m in np.unique(count):
        own = count == m
        if 0 < m <= INVERTED:
            out[own] = np.searchsorted(_EDGES[int(m)], u[own].ravel(), "left").reshape(-1, u.shape[1])
        elif m > 0:
            z = np.sqrt(-2 * np.log(u[own])) * np.cos(2 * math.pi * (mix(h[own] ^ 7) + 0.5) / 2.0**32)
            out[own] = np.maximum(np.round(m + math.sqrt(m) * z), 0)
    return out


def bucket_sums(v: np.ndarray, p: np.ndarray, q: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """(positives, negatives, pairs in order with half the ties) of the bucket's scores, by round."""
    order = np.argsort(v)
    v, p, q = v[order], p[order], q[order]
    out = np.zeros((3, rounds))
    first, second, keys = round_keys(rounds, seed), round_keys(rounds, seed + 1), value_keys(v)
    for a in range(0, len(v), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        x, y = draws(p[part], keys[part], first), draws(q[part], keys[part], second)
        below = out[1] + np.cumsum(y, axis=0) - y / 2
        out[2] += (x * below).sum(axis=0)
        out[0] += x.sum(axis=0)
        out[1] += y.sum(axis=0)
    return out


def interval(buckets: list, ci: float):
    """(low, high) of the rounds' AUC from the sums of buckets in order of their scores."""
    positives = negatives = pairs = 0.0
    for p, q, s in buckets:
        pairs = pairs + s + p * negatives
        positives, negatives = positives + p, negatives + q
    good = (positives > 0) & (negatives > 0)
    if not np.any(good):
        return None, None
    a = pairs[good] / positives[good] / negatives[good]
    return tuple(float(x) for x in np.quantile(a, [(1 - ci) / 2, (1 + ci) / 2]))
