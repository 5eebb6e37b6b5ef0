"""Counts of points within a radius, block by block, without a row for each pair.

The right points of a block are sorted by the cells of a fine grid.  Whether two
cells lie wholly within the radius, or wholly beyond it, follows from how many
rows and columns are between them: runs of cells within are counted from sums
over the sorted points, and only points in cells on the rim are compared.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

#: Cells of the fine grid for a radius, at most; points compared at once; a margin for rounding, as a share of the squared radius.
FINEST, AT_ONCE, SLACK = 512, 2_000_000, 1e-6

#: Places that are packed together, at least as long as there are more.
PACKED = 100_000


def packing(size: float):
    """Batches of places (x, y, number) to rows (_hx, _hy, _m, _p): ``_m`` places of a cell as one run of bytes, without the numbers if all are 1."""

    def run(batches):
        held, many = [], 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            many += b.num_rows
            if many >= PACKED:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)), size)
                held, many = [], 0
        if many:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), size)

    return run


def _packed(x: np.ndarray, y: np.ndarray, n: np.ndarray, size: float):
    import pyarrow as pa

    hx, hy = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    order = np.lexsort((hy, hx))
    x, y, n, hx, hy = x[order], y[order], n[order], hx[order], hy[order]
    at = np.flatnonzero(np.concatenate([[True], (hx[1:] != hx[:-1]) | (hy[1:] != hy[:-1])]))
    ends = np.append(at[1:], len(x))
    runs = [x[a:b].tobytes() + y[a:b].tobytes() + (n[a:b].tobytes() if (n[a:b] != 1).any() else b"") for a, b in zip(at, ends, strict=True)]
    return pa.record_batch([pa.array(hx[at]), pa.array(hy[at]), pa.array(ends - at), pa.array(runs, pa.binary())], names=["_hx", "_hy", "_m", "_p"])


def unpacked(sizes: list[int], runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and number of the places in ``packing``'s rows."""
    xs, ys, ns = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for m, p in zip(sizes, runs, strict=True):
        xs.append(np.frombuffer(p, np.float64, m))
        ys.append(np.frombuffer(p, np.float64, m, 8 * m))
        ns.append(np.frombuffer(p, np.int64, m, 16 * m) if len(p) > 16 * m else np.ones(m, np.int64))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ns)


def counts(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, weight: np.ndarray, r: float, inclusive: bool = True) -> np.ndarray:
    """For each (x, y) the sum of ``weight`` of the points (px, py) at most (or less than) ``r`` apart."""
    out = np.zeros(len(x), np.int64)
    if not len(x) or not len(px):
        return out
    wide, high = np.ptp(x) + 2 * r, np.ptp(y) + 2 * r
    g = int(np.clip(2 * (len(px) / wide / high) ** 0.5 * r, 4, FINEST))
    size, pad = r / g, g + 3
    x0, y0 = x.min() - pad * size, y.min() - pad * size
    col, row = np.floor((x - x0) / size).astype(np.int64), np.floor((y - y0) / size).astype(np.int64)
    cols, rows = int(col.max()) + pad + 1, int(row.max()) + pad + 1
    pc, pr = np.floor((px - x0) / size), np.floor((py - y0) / size)
    near = (pc >= 0) & (pc < cols) & (pr >= 0) & (pr < rows)
    cell = pr[near].astype(np.int64) * cols + pc[near].astype(np.int64)
    order = np.argsort(cell, kind="stable")
    px, py, weight = px[near][order], py[near][order], weight[near][order]
    start = np.concatenate([[0], np.bincount(cell, minlength=rows * cols).cumsum()])
    upto = np.concatenate([[0], weight.cumsum()])[start]
    by = np.lexsort((x, y, col, row))
    x, y, home = x[by], y[by], (row * cols + col)[by]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])  # points at one place are looked up once
    x, y, home = x[new], y[new], home[new]
    total = np.zeros(len(x), np.int64)
    for dr in range(-g - 1, g + 2):
        inner = g * g * (1 - SLACK) - (abs(dr) + 1) ** 2
        inner = int(inner**0.5) - 1 if inner >= 1 else -1
        outer = int((g * g * (1 + SLACK) - max(abs(dr) - 1, 0) ** 2) ** 0.5) + 1
        at = home + dr * cols
        if inner < 0:
            ranges = [(start[at - outer], start[at + outer + 1])]
        else:
            total += upto[at + inner + 1] - upto[at - inner]
            ranges = [(start[at - outer], start[at - inner]), (start[at + inner + 1], start[at + outer + 1])]
        for first, last in ranges:
            _compared(total, x, y, px, py, weight, first, last - first, r * r, inclusive)
    out[by] = total[np.cumsum(new) - 1]
    return out


def _compared(total, x, y, px, py, weight, first, many, r2, inclusive):
    """Adds to ``total`` the points of the runs that begin at ``first`` and are ``many`` long."""
    some = np.flatnonzero(many)
    ends = many[some].cumsum()
    a = 0
    while a < len(some):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        own, n = some[a:b], many[some[a:b]]
        who = np.repeat(np.arange(b - a), n)
        point = np.repeat(first[own] - (ends[a:b] - n - before), n) + np.arange(len(who))
        dx, dy = x[own][who] - px[point], y[own][who] - py[point]
        d2 = dx * dx + dy * dy
        hit = d2 <= r2 if inclusive else d2 < r2
        total[own] += np.bincount(who, weight[point] * hit, b - a).astype(np.int64)
        a = b
