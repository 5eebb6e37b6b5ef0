"""Boosted trees of one model within one task: histograms of binned features, leaf-wise growth.

A tree is grown level by level and then cut back to the splits that growth by the
largest gain would have made, which are the same as no split depends on another branch.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

BINS = 255
#: Rows whose leaves are looked up at once.
CHUNK = 1 << 18


def _sides(inner: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a perfect tree of at most 64 leaves, the leaves on its left and on its right, as bits."""
    left, right = [], []
    for k in range(inner):
        level = (k + 1).bit_length() - 1
        half = (inner + 1 >> level) // 2
        first = (k + 1 - 2**level) * 2 * half
        left.append(2**half - 1 << first)
        right.append(2**half - 1 << first + half)
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _tables(feature: np.ndarray, cut: np.ndarray, widths: list[int]) -> list[tuple[int, np.ndarray]]:
    """A tree as (feature, leaves by bin): the leaves that the feature's splits leave open, as bits.

    A node sends bins above ``cut`` to the right; without a split (-1) all go left.
    All features together leave one leaf open.
    """
    left, right = _sides(len(cut))
    whole = cut < 0
    open_ = ~np.bitwise_or.reduce(right[whole], initial=np.uint64(0)) & np.uint64(2 ** (len(cut) + 1) - 1)
    tables = []
    for j in np.unique(feature[~whole]):
        own = np.flatnonzero(~whole & (feature == j))
        over = np.arange(widths[j])[:, None] > cut[own]
        tables.append((int(j), np.bitwise_and.reduce(np.where(over, ~left[own], ~right[own]), axis=1) & open_))
    return tables


def _leaf(tables: list[tuple[int, np.ndarray]], bins: list[np.ndarray], n: int) -> np.ndarray:
    """The leaf of each of ``n`` rows, whose bins are given by feature."""
    if not tables:
        return np.zeros(n, np.int64)
    at = tables[0][1].take(bins[tables[0][0]])
    for j, table in tables[1:]:
        at &= table.take(bins[j])
    return np.frexp(at.astype(float))[1] - 1


class Trees:
    """Perfect trees in arrays: feature and threshold by (tree, node), value by (tree, leaf); ``fill`` stands for missing features."""

    def __init__(self, feature, threshold, value, base, fill):
        self.feature, self.threshold, self.value, self.base, self.fill, self.tables = feature, threshold, value, base, fill, None

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill, x)
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.threshold.shape[1]
        if inner > 63:
            for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
                node = np.zeros(len(x), np.int64)
                while len(node) and node[0] < inner:
                    node = 2 * node + 1 + (x[rows, f[node]] > t[node])
                total += v[node - inner]
            return 1 / (1 + np.exp(-total))
        if self.tables is None:
            split = self.threshold < np.inf
            self.cuts = [np.unique(self.threshold[split & (self.feature == j)]) for j in range(x.shape[1])]
            cut = np.full(split.shape, -1)
            for j, u in enumerate(self.cuts):
                own = split & (self.feature == j)
                cut[own] = np.searchsorted(u, self.threshold[own])
            self.tables = [_tables(f, c, [len(u) + 1 for u in self.cuts]) for f, c in zip(self.feature, cut, strict=True)]
        bins = [np.searchsorted(u, c, "left") for u, c in zip(self.cuts, x.T, strict=True)]
        for tables, v in zip(self.tables, self.value, strict=True):
            total += v.take(_leaf(tables, bins, len(x)))
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray) -> np.ndarray:
    """Between neighbouring values where they are few, else quantiles."""
    u = np.unique(x)
    return (u[1:] + u[:-1]) / 2 if len(u) <= BINS else np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]))


def fit(x: np.ndarray | list, y: np.ndarray, trees: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 42, leaves: int = 31, least: int = 20, share: float = 0.8) -> Trees:
    """``trees`` of at most ``leaves`` leaves with ``least`` rows each, on ``share`` of the rows and features; both classes have the same mass.

    Missing features have the median.  Rows are put in order first, so the model does not depend on how they arrive.
    ``x`` may be a list of columns, which is emptied: of the values only a byte each is held while trees grow.
    """
    columns = x if isinstance(x, list) else list(x.T)
    order = np.lexsort((y, *columns))
    y, f, n = y[order], len(columns), len(y)
    fill, edges, binned = np.zeros(f), [], []
    for j in range(f):
        c = columns.pop(0)[order]
        gone = np.isnan(c)
        if not gone.all():
            fill[j] = np.median(c[~gone])
        c[gone] = fill[j]
        edges.append(_edges(c))
        binned.append(np.concatenate([np.searchsorted(edges[j], c[i : i + CHUNK], "left").astype(np.uint8) for i in range(0, n, CHUNK)] or [np.zeros(0, np.uint8)]))
    del order
    inner, pos = 2**depth - 1, float((y == 1).sum())
    if pos in (0.0, float(n)):
        p = (pos + 1) / (n + 2)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))), fill)
    draws, raw = np.random.RandomState(seed), np.zeros(n)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        rows = draws.rand(n) < share
        p, own = 1 / (1 + np.exp(-raw[rows])), y[rows]
        weight = np.where(own == 1, n / (2 * pos), n / (2 * (n - pos)))
        used = np.sort(draws.permutation(f)[: max(1, round(share * f))])
        g, h = weight * (p - own), weight * p * (1 - p)
        del p, own, weight
        bins = {j: binned[j][rows] for j in used}
        base, gain, at = np.zeros(len(g), np.int32), np.full(inner, -1.0), np.full(inner, -1)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            keys = {}
            for j in used:
                if not len(edges[j]):
                    continue
                keys[j] = base + bins[j]
                gs, hs, ns = (np.bincount(keys[j], v, count * BINS).reshape(count, BINS).cumsum(axis=1) for v in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    own = gs**2 / hs + (gt - gs) ** 2 / (ht - hs) - gt**2 / ht
                own[(ns < least) | (nt - ns < least) | (hs < 1e-3) | (ht - hs < 1e-3)] = -1
                best = own.argmax(axis=1)
                top = own[np.arange(count), best]
                better = first + np.flatnonzero(top > np.maximum(gain[first : first + count], 1e-9))
                gain[better], at[better], feature[t, better] = top[better - first], best[better - first], j
            if level + 1 < depth:
                here = slice(first, first + count)
                over = np.arange(BINS) > at[here, None]
                split = np.zeros(len(g), bool)
                for j, key in keys.items():
                    of = (feature[t, here] == j) & (at[here] >= 0)
                    if of.any():
                        split |= (over & of[:, None]).ravel().take(key)
                base = 2 * base + np.int32(BINS) * split
        heap, left, cut = [(-gain[0], 0)] if gain[0] > 0 else [], leaves - 1, np.full(inner, -1)
        while heap and left:
            _, k = heapq.heappop(heap)
            threshold[t, k], cut[k], left = edges[feature[t, k]][at[k]], at[k], left - 1
            for c in (2 * k + 1, 2 * k + 2):
                if c < inner and gain[c] > 0:
                    heapq.heappush(heap, (-gain[c], c))
        if depth <= 6:
            tables = _tables(feature[t], cut, [BINS] * f)
            leaf = np.concatenate([_leaf(tables, [c[i : i + CHUNK] for c in binned], min(CHUNK, n - i)).astype(np.uint8) for i in range(0, n, CHUNK)])
        else:
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                over = np.zeros(n, bool)
                for j, e in enumerate(edges):
                    of = feature[t, node] == j
                    over[of] = binned[j][of] > np.searchsorted(e, threshold[t, node[of]])
                node = 2 * node + 1 + over
            leaf = node - inner
        gl, hl = np.bincount(leaf[rows], g, inner + 1), np.bincount(leaf[rows], h, inner + 1)
        value[t] = -rate * gl / np.maximum(hl, 1e-12) * (hl > 0)
        del g, h, bins, keys, base
        raw += value[t, leaf]
    return Trees(feature, threshold, value, 0.0, fill)
