"""Toxicity: a bidirectional GRU with attention pooling over words and characters, in numpy.

A word enters as the sum of a hashed word embedding and the mean of hashed
character-trigram embeddings, already multiplied into the gates.  A text is
scored by all its overlapping windows (``size`` words, ``stride`` apart, the last
one flush with the end); its score is the highest one.  Training knows only the
label of the text, so each step learns from the window that scores highest now.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written
from .quality_gbt import labelled

SIZE, STRIDE = 64, 32
WORDS, GRAMS, DIM, HIDDEN = 1 << 15, 1 << 12, 12, 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(offs: np.ndarray, raw: np.ndarray):
    """(distinct words as (bucket, gram ids, gram bounds), index of every word into them, first word of each document)."""
    start, end, first = K.words_of(offs, raw)
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(offs) - 1:  # prefix sums of a few documents at a time
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1)
        own = slice(first[at], first[to])
        h[own] = K.range_hash(K.byte_sums(raw[offs[at] : offs[to]], folded=True), start[own] - offs[at], end[own] - offs[at])
        at = to
    unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[where], end[where]
    size = e - s
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(s - bounds[:-1], size) + np.arange(bounds[-1])
    data = _FOLD[raw].astype(np.uint32)
    left = np.where(at == np.repeat(s, size), 0, data[at - 1])
    right = np.where(at == np.repeat(e, size) - 1, 0, data[np.minimum(at + 1, max(0, len(raw) - 1))])
    grams = (left * np.uint32(0x9E3779B1) ^ data[at] * np.uint32(0x85EBCA77) ^ right * np.uint32(0xC2B2AE3D)) if len(at) else np.zeros(0, np.uint32)
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)
    return ((unique >> np.uint64(49)).astype(np.int64), grams, bounds), inverse, first


def window_starts(first: np.ndarray, size: int = SIZE, stride: int = STRIDE):
    """(document, first word, words) of all windows; a document without words has none."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - size) // stride)))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(k * stride, np.maximum(0, n[doc] - size))
    return doc, first[doc] + at, np.minimum(n[doc], size)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Gru:
    """Parameters by name: words, grams (embeddings), wf/wb (input to gates), uf/ub (state to gates), bf/bb, a, v (attention), o, c (output)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def new(cls, seed: int = 7) -> Gru:
        r = np.random.Generator(np.random.PCG64(seed))
        f = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        h = HIDDEN
        p = {"words": f(WORDS, DIM), "grams": f(GRAMS, DIM), "a": f(2 * h, 2 * h, k=0.3), "v": f(2 * h, k=0.3), "o": f(2 * h, k=0.3), "c": np.full(1, -1.5, np.float32)}
        for d in "fb":
            p |= {f"w{d}": f(DIM, 3 * h, k=0.4), f"u{d}": f(h, 3 * h, k=0.3), f"b{d}": np.zeros(3 * h, np.float32)}
        return cls(p)

    def word_inputs(self, distinct) -> np.ndarray:
        bucket, grams, bounds = distinct
        x = self.p["words"][bucket]
        if len(bucket):
            x = x + np.add.reduceat(self.p["grams"][grams], bounds[:-1]) / np.diff(bounds)[:, None].astype(np.float32)
        return x

    def _direction(self, gates: np.ndarray, d: str, mask, keep: bool):
        """gates: steps x windows x 3h in the order of reading; states in that order, and what back-propagation needs."""
        h, u = HIDDEN, self.p[f"u{d}"]
        state = np.zeros((gates.shape[1], h), np.float32)
        states = np.empty((*gates.shape[:2], h), np.float32)
        saved = []
        for t in range(len(gates)):
            g = gates[t]
            hu = state @ u
            zr = _sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
            new = n + z * (state - n)
            if mask is not None:
                new = new * mask[t]
            if keep:
                saved.append((state, z, r, n, hu[:, 2 * h :]))
            state = states[t] = new
        return states, saved

    def forward(self, x: np.ndarray, mask=None, keep: bool = False):
        """x: steps x windows x DIM word inputs; mask: steps x windows x 1. Probabilities, and what ``backward`` needs."""
        p = self.p
        return self.from_gates(x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], mask, keep)

    def from_gates(self, gf, gb, mask=None, keep=False):
        p = self.p
        sf, kf = self._direction(gf, "f", mask, keep)
        sb, kb = self._direction(gb[::-1], "b", None if mask is None else mask[::-1], keep)
        s = np.concatenate([sf, sb[::-1]], axis=2)
        q = np.tanh(s @ p["a"])
        e = q @ p["v"]
        if mask is not None:
            e = np.where(mask[:, :, 0] > 0, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, s)
        out = _sigmoid(pooled @ p["o"] + p["c"][0])
        return (out, (s, q, alpha, pooled, kf, kb)) if keep else out

    def backward(self, x, mask, out, kept, y):
        """Gradients of the mean logistic loss; that of the inputs under ``x``."""
        p, h, (s, q, alpha, pooled, kf, kb) = self.p, HIDDEN, kept
        d = ((out - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["o"]
        ds = alpha[:, :, None] * dp
        da = np.einsum("tnh,nh->tn", s, dp)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, q)
        dq = de[:, :, None] * p["v"] * (1 - q**2)
        g["a"] = np.einsum("tnh,tnk->hk", s, dq)
        ds = ds + dq @ p["a"].T
        g["x"] = np.zeros_like(x)
        for name, kept_d, part, rev in (("f", kf, ds[:, :, :h], False), ("b", kb, ds[:, :, h:][::-1], True)):
            u, w = p[f"u{name}"], p[f"w{name}"]
            xs = x[::-1] if rev else x
            ms = None if mask is None else (mask[::-1] if rev else mask)
            gu, gw, gbias = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h, np.float32)
            carry = np.zeros_like(part[0])
            for t in range(len(part) - 1, -1, -1):
                state, z, r, n, hn = kept_d[t]
                total = part[t] + carry
                if ms is not None:
                    total = total * ms[t]
                dz = total * (state - n) * z * (1 - z)
                dn = total * (1 - z) * (1 - n**2)
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                dg = np.concatenate([dz, dr, dn], axis=1)
                carry = total * z + dhu @ u.T
                gu += state.T @ dhu
                gw += xs[t].T @ dg
                gbias += dg.sum(axis=0)
                g["x"][len(part) - 1 - t if rev else t] += dg @ w.T
            g |= {f"u{name}": gu, f"w{name}": gw, f"b{name}": gbias}
        return g

    def score_windows(self, distinct, inverse, at, size, block: int = 512) -> np.ndarray:
        """Probabilities of windows of ``inverse`` that start at ``at`` and have ``size`` words."""
        x = self.word_inputs(distinct)
        gf, gb = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        out = np.zeros(len(at), np.float32)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(at), block):
            own = order[a : a + block]
            most = int(size[own].max())
            step = np.arange(most)[:, None]
            mask = None
            if size[own].min() < most:
                mask = (step < size[own]).astype(np.float32)[:, :, None]
            ids = inverse[np.minimum(at[own] + step, len(inverse) - 1)]
            out[own] = self.from_gates(gf[ids], gb[ids], mask)
        return out

    def score(self, offs, raw) -> np.ndarray:
        """The highest window score of each document; 0 without words."""
        distinct, inverse, first = tokens(offs, raw)
        doc, at, size = window_starts(first)
        out = np.zeros(len(offs) - 1)
        np.maximum.at(out, doc, self.score_windows(distinct, inverse, at, size))
        return out


def fit(offs: np.ndarray, raw: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, steps: int = 300, rate: float = 0.01, seed: int = 7) -> Gru:
    """Adam on the currently highest window of each document, for ``epochs`` or at least ``steps`` batches; embeddings are updated where touched."""
    model = Gru.new(seed)
    distinct, inverse, first = tokens(offs, raw)
    doc, at, size = window_starts(first)
    have = np.flatnonzero(np.diff(first) > 0)
    if not len(have):
        model.p["c"][:] = -4
        return model
    r = np.random.Generator(np.random.PCG64(seed))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    bucket, grams, bounds = distinct
    epochs = max(epochs, -(-steps * batch // len(have)))
    step = 0
    for epoch in range(epochs):
        s = model.score_windows(distinct, inverse, at, size)
        if epoch == 0:
            s = r.random(len(at))
        order = np.lexsort((s, doc))
        best = order[np.append(np.flatnonzero(np.diff(doc[order])), len(doc) - 1)]  # the highest window of each document with words
        mix = r.permutation(len(best))
        lr = rate * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(mix), batch):
            own = best[mix[a : a + batch]]
            most = int(size[own].max())
            place = np.arange(most)[:, None]
            mask = (place < size[own]).astype(np.float32)[:, :, None]
            ids = inverse[np.minimum(at[own] + place, len(inverse) - 1)]
            words, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            n = np.diff(bounds)[words]
            gb = np.concatenate([[0], np.cumsum(n)])
            gi = grams[np.repeat(bounds[words] - gb[:-1], n) + np.arange(gb[-1])]
            xw = model.word_inputs((bucket[words], gi, gb))
            x = xw[local]
            drop = (r.random((*x.shape[:2], 1)) > 0.1).astype(np.float32)
            x = x * drop
            out, kept = model.forward(x, mask, keep=True)
            g = model.backward(x, mask, out, kept, y[doc[own]])
            gx = np.zeros_like(xw)
            np.add.at(gx, local, g.pop("x") * drop)
            gg = np.repeat(gx / n[:, None].astype(np.float32), n, axis=0)
            step += 1
            norm = np.sqrt(sum((v**2).sum() for v in g.values())) + 1e-9
            for k, v in g.items():
                v = v * min(1.0, 5.0 / norm)
                m1, m2 = moment[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                model.p[k] -= (lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            for k, where, v in (("words", bucket[words], gx), ("grams", gi, gg)):
                rows, back = np.unique(where, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, back, v)
                m1, m2 = moment[k]
                m1[rows] += 0.1 * (total - m1[rows])
                m2[rows] += 0.01 * (total**2 - m2[rows])
                model.p[k][rows] -= lr * m1[rows] / (np.sqrt(m2[rows]) + 1e-6) + lr * 2e-3 * model.p[k][rows]
    return model


def one_per_id(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, y of the ``chosen`` ids: one row for each id, by hash where its texts differ; null texts are left out."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.text", "r.y")


def byte_bound(sizes: list[int], most: int) -> int:
    """The largest text length so that all texts of at most that length hold ``most`` bytes together; the shortest text always fits."""
    total, bound = 0, min(sizes, default=0)
    for size in sorted(sizes):
        total += size
        if total > most:
            break
        bound = size
    return bound


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, at_most: int = 4_000, max_bytes: int = 16 << 20, **params) -> Gru:
    """Fits on at most ``at_most`` labelled documents, chosen by a hash of the id.

    Where their texts hold more than ``max_bytes`` together, the longest are left
    out, so one very long text costs itself only.  An id that repeats counts once.
    """
    rows = written(one_per_id(docs, labelled(labels, label, modulus, held_out, at_most)))
    sizes = [r[0] for r in rows.select(F.octet_length("text")).collect()]  # at most ``at_most``
    longest = byte_bound(sizes, max_bytes)
    if sum(s for s in sizes if s <= longest) > max_bytes:  # ties at the bound: as many as fit, by hash
        room = max(1, (max_bytes - sum(s for s in sizes if s < longest)) // max(1, longest))
        ties = rows.where(F.octet_length("text") == longest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(room)
        rows = rows.where(F.octet_length("text") < longest).unionByName(ties)
    else:
        rows = rows.where(F.octet_length("text") <= longest)
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    offs, raw = K.offsets_of(table.column("text"))
    return fit(offs, raw, table.column("y").to_numpy().astype(np.float32), **params)


def classify(docs: DataFrame, model: Gru, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score double and predicted int of every row of ``docs``.

    Texts without words (null, empty, white space) score 0.  Repeated rows and
    ids are scored alike; an empty table gives no rows.  Only ``text`` is an
    input of the score.
    """
    text = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))

    def run(batches):
        for b in K.chunks(batches, text, 1 << 20):
            score = model.score(*K.offsets_of(b.column(text)))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
