"""Fire histories of the places of one block: distances and counts by perimeters, in arrays, without a row for each pair.

A cell decides for all its places what its centre's distance, give or take half a
diagonal, settles: perimeters surely nearer than a limit are counted at once, those
surely farther are left out, and the open ones go down to the cell's quarters with
the edges that can still be nearest.  Where few places are left, they are measured.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library

#: Places of a cell that is not quartered any more; quarterings at most; distances measured at once; shares by which bounds are widened.
FEW, DEEPEST, AT_ONCE, SLACK = 16, 12, 500_000, 1e-6


def edge_distance(x, y, e):
    """Distance of (x, y) to the edges ``e`` (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = e
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = (x - x1) * dx + (y - y1) * dy
    t = np.clip(np.divide(t, square, out=np.zeros_like(t), where=square != 0), 0.0, 1.0)
    u, v = x - x1 - t * dx, y - y1 - t * dy
    return np.sqrt(u * u + v * v)


def circle_distance(x, y, e):
    """Distance of (x, y) to the centres of the circles ``e`` (fx, fy, r), less the radius: below zero inside."""
    u, v = x - e[0], y - e[1]
    return np.sqrt(u * u + v * v) - e[2]


def _starts(of: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))


class Block:
    """Places ``x``, ``y`` and pieces: edges of polygons, or circles, in the order of their perimeters' ids.

    ``of`` has each piece's perimeter (a number for each; its pieces are together),
    ``part`` its part, ``outer`` whether it is of an outer ring, ``w`` the weight of
    its perimeter.  ``run`` fills dist and best (the nearest outer piece), counts
    within ``near`` and ``far``, inside, and the weights within ``far``.
    """

    def __init__(self, x, y, pieces, of, part, outer, w, near: float, far: float, size: float, circles: bool):
        self.x, self.y, self.e, self.of, self.w, self.size, self.circles = x, y, pieces, of, w, size, circles
        self.far, self.limits = far, (near, far, 0.0) if circles else (near, far)
        self.slack = (far + size) * SLACK
        self.outer = np.flatnonzero(outer)
        self.area = circle_distance if circles else edge_distance
        self.line = (lambda *a: np.abs(circle_distance(*a))) if circles else edge_distance
        self.parts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
        self.dist, self.best = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        self.counts, self.weight = np.zeros((3, len(x)), np.int64), np.zeros(len(x))

    def run(self) -> None:
        qx, qy = np.floor(self.x / self.size), np.floor(self.y / self.size)
        order = np.lexsort((qy, qx))
        at = np.flatnonzero(np.concatenate([[True], (np.diff(qx[order]) != 0) | (np.diff(qy[order]) != 0)]))
        for who in np.split(order, at[1:]):
            self._cell(who, (qx[who[0]] + 0.5) * self.size, (qy[who[0]] + 0.5) * self.size)

    def _cell(self, who, cx: float, cy: float) -> None:
        half = self.size * 0.5**0.5 * (1 + SLACK) + self.slack
        d = self.area(cx, cy, self.e)
        line = np.abs(d[self.outer])
        if len(line):
            self._nearest(who, cx, cy, self.size, self.outer[line <= line.min() + 2 * half])
        cut = _starts(self.of)
        m, n = np.minimum.reduceat(d, cut), np.diff(np.append(cut, len(d)))
        open_ = np.tile(m - half < self.far, (len(self.limits), 1))
        if not self.circles:
            within = self._within(who, cx, cy, d, half, cut)
            self.counts[:, who] += int(within.sum())
            self.weight[who] += self.w[cut][within].sum()
            open_ &= ~within
        keep = open_.any(axis=0)
        at = np.flatnonzero(np.repeat(keep, n) & (d <= np.repeat(m + 2 * half, n)))
        self._count(who, cx, cy, self.size, at, open_[:, keep], 0)

    def _within(self, who, cx: float, cy: float, d, half: float, cut):
        """Perimeters that hold the whole cell; places inside others are marked as such."""
        x1, y1, x2, y2 = self.e
        span = np.flatnonzero((y1 > cy) != (y2 > cy))
        a, b, c, e = (v[span] for v in self.e)
        odd = np.zeros(len(self.of), bool)
        odd[span[cx < (c - a) * (cy - b) / (e - b) + a]] = True
        odd = np.add.reduceat(odd, self.parts, dtype=np.int64) % 2 == 1
        clear = np.minimum.reduceat(d, self.parts) > half
        first = np.searchsorted(self.parts, cut)  # the first part of each perimeter
        within = np.logical_or.reduceat(odd & clear, first)
        if not within.any() and not clear.all():
            many = np.diff(np.append(self.parts, len(d)))
            low, high = cy - half, cy + half
            met = np.flatnonzero(np.repeat(~clear, many) & (np.minimum(y1, y2) <= high) & (np.maximum(y1, y2) >= low))
            own = _starts(np.repeat(np.arange(len(many)), many)[met]) if len(met) else met
            a, b, c, e = (v[met] for v in self.e)
            for some in self._steps(who, met):
                x, y = self.x[some, None], self.y[some, None]
                slope = np.divide((c - a) * (y - b), e - b, out=np.full((len(some), len(met)), -np.inf), where=e != b)
                crosses = ((b > y) != (e > y)) & (x < slope + a)
                on = ((c - a) * (y - b) == (e - b) * (x - a)) & (x >= np.minimum(a, c)) & (x <= np.maximum(a, c)) & (y >= np.minimum(b, e)) & (y <= np.maximum(b, e))
                inside = (np.add.reduceat(crosses, own, axis=1, dtype=np.int64) % 2 == 1) & ~np.logical_or.reduceat(on, own, axis=1)
                self.counts[2, some] += inside.any(axis=1)
        return within

    def _steps(self, who, at):
        if len(at):
            step = max(1, AT_ONCE // len(at))
            for i in range(0, len(who), step):
                yield who[i : i + step]

    def _quarters(self, who, cx: float, cy: float, size: float):
        east, north = self.x[who] >= cx, self.y[who] >= cy
        for dx, right in ((-0.25, ~east), (0.25, east)):
            for dy, up in ((-0.25, ~north), (0.25, north)):
                own = who[right & up]
                if len(own):
                    yield own, cx + dx * size, cy + dy * size, size / 2

    def _nearest(self, who, cx: float, cy: float, size: float, at, depth: int = 0) -> None:
        """The nearest of the pieces ``at`` for the places ``who`` of a cell; the first of equally near ones."""
        if len(who) <= FEW or depth == DEEPEST:
            e = self.e[:, at]
            for some in self._steps(who, at):
                d = self.line(self.x[some, None], self.y[some, None], e)
                self.dist[some], self.best[some] = d.min(axis=1), at[d.argmin(axis=1)]
            return
        for own, ax, ay, half in self._quarters(who, cx, cy, size):
            d = self.line(ax, ay, self.e[:, at])
            self._nearest(own, ax, ay, half, at[d <= d.min() + half * 2**0.5 * (1 + SLACK) + 2 * self.slack], depth + 1)

    def _count(self, who, cx: float, cy: float, size: float, at, open_, depth: int) -> None:
        """Counts the perimeters of the pieces ``at`` for the places ``who`` of a cell; ``open_``: limits that are not settled, by perimeter."""
        if not len(at):
            return
        half = size * 0.5**0.5 * (1 + SLACK) + self.slack
        d = self.area(cx, cy, self.e[:, at])
        cut = _starts(self.of[at])
        m, n = np.minimum.reduceat(d, cut), np.diff(np.append(cut, len(at)))
        still = np.empty_like(open_)
        for k, limit in enumerate(self.limits):
            sure = open_[k] & (m + half < limit)
            self.counts[k, who] += int(sure.sum())
            if k == 1:
                self.weight[who] += self.w[at[cut[sure]]].sum()
            still[k] = open_[k] & ~sure & (m - half < limit)
        keep = still.any(axis=0)
        at, still = at[np.repeat(keep, n) & (d <= np.repeat(m + 2 * half, n))], still[:, keep]
        if not len(at):
            return
        if len(who) > FEW and depth < DEEPEST:
            for own, ax, ay, side in self._quarters(who, cx, cy, size):
                self._count(own, ax, ay, side, at, still, depth + 1)
            return
        cut, e = _starts(self.of[at]), self.e[:, at]
        for some in self._steps(who, at):
            d = np.minimum.reduceat(self.area(self.x[some, None], self.y[some, None], e), cut, axis=1)
            for k, limit in enumerate(self.limits):
                hit = (d < limit) & still[k]
                self.counts[k, some] += hit.sum(axis=1)
                if k == 1:
                    self.weight[some] += hit @ self.w[at[cut]]


def histories(columns: list[str], near: float, far: float, size: float):
    """Points (_r, x, y) and pieces (_p, pid, part, outer, w, ``columns``) of a block to rows (_r, d, pid, near, far, inside, w)."""

    def run(points, pieces):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pieces.schema.field("pid").type
        if not points.num_rows or not pieces.num_rows:
            kinds = {"_r": pa.int64(), "d": pa.float64(), "pid": kind, "near": pa.int64(), "far": pa.int64(), "inside": pa.int64(), "w": pa.float64()}
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        pieces = pieces.take(pc.sort_indices(pieces, [(c, "ascending") for c in ("pid", "_p", "part")], null_placement="at_start"))
        of, part, outer, w = (pieces.column(c).to_numpy() for c in ("_p", "part", "outer", "w"))
        x, y = (points.column(c).to_numpy() for c in "xy")
        places, back = np.unique(x + 1j * y, return_inverse=True)  # a place is looked up once
        b = Block(places.real.copy(), places.imag.copy(), np.array([pieces.column(c).to_numpy() for c in columns]), of, part, outer, w, near, far, size, len(columns) == 3)
        b.run()
        found = np.isfinite(b.dist)[back]
        pid = pieces.column("pid").take(pa.array(b.best[back], mask=~found))
        return pa.table({"_r": points.column("_r"), "d": pa.array(b.dist[back], mask=~found), "pid": pid, "near": b.counts[0][back], "far": b.counts[1][back], "inside": b.counts[2][back], "w": b.weight[back]})

    return run
