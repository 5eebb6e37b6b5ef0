"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features with the logistic loss and
flattened into arrays of a perfect binary tree each, so scoring is ``depth``
rounds of numpy gathers over (documents x trees).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Bytes by class; everything else is class 0.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".?;:,", "shout": b"!", "hash": b"#$%&*", "bar": b"|<>{}[]=_\\^~", "quote": b"'\"()-", "at": b"@/+"}
_LUT = np.zeros(256, np.uint8)
for _i, _set in enumerate(CLASSES.values(), 1):
    _LUT[list(_set)] = _i
_LUT[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
NAMES = [*(f"share_{c}" for c in ("other", *CLASSES, "wide")), "log_bytes", "log_words", "word_bytes", "word_bytes_dev", "distinct_words", "long_words", "line_words", "distinct_lines", "odd_ends", "upper_starts", "upper_words", "word_entropy"]


def statistics(offs: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per document; all zero for an empty text."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)), np.float64)
    size = np.diff(offs)
    kind = _LUT[raw]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    some = np.maximum(size, 1)
    out[:, :N_CLASSES] = counts / some[:, None]
    start, end, first = K.words_of(offs, raw)
    words = np.diff(first)
    any_words = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    length = (end - start).astype(np.float64)
    mean = np.bincount(owner, length, n) / any_words
    dev = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / any_words - mean**2, 0))
    h = K.range_hash(K.byte_sums(raw, folded=True), start, end)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    run_owner = owner[order][fresh]
    share = runs / any_words[run_owner]
    entropy = -np.bincount(run_owner, share * np.log(share), n)
    lines = counts[:, list(CLASSES).index("newline") + 1] + 1
    breaks = np.zeros(256, bool)
    breaks[10] = True
    ls, le, lf = K.words_of(offs, raw, breaks)
    lh = K.range_hash(K.byte_sums(raw), ls, le)
    line_owner = np.repeat(np.arange(n), np.diff(lf))
    lo = np.lexsort((lh, line_owner))
    new_line = np.ones(len(lh), bool)
    new_line[1:] = (lh[lo][1:] != lh[lo][:-1]) | (line_owner[lo][1:] != line_owner[lo][:-1])
    last, head = kind[end - 1] if len(end) else np.zeros(0, np.uint8), kind[start] if len(start) else np.zeros(0, np.uint8)
    letters = (1, 2, len(CLASSES) + 1)
    odd = ~np.isin(last, letters) & ~np.isin(raw[end - 1] if len(end) else np.zeros(0, np.uint8), list(b".,"))
    capital = head == 2
    all_caps = capital & (last != 1) & (length > 2) & (kind[np.minimum(start + 1, max(0, len(raw) - 1))] != 1 if len(raw) else np.zeros(0, bool))
    per_word = lambda x: np.bincount(owner, x, n) / any_words
    more = [np.log1p(size), np.log1p(words), mean, dev, np.bincount(run_owner, minlength=n) / any_words, per_word(length > 14), words / lines, np.bincount(line_owner[lo][new_line], minlength=n) / np.maximum(np.diff(lf), 1), per_word(odd), per_word(capital), per_word(all_caps), entropy]
    out[:, N_CLASSES:] = np.stack(more, axis=1)
    out[size == 0] = 0
    return out


class Trees:
    """Boosted perfect trees in arrays: feature and threshold by (tree, node), value by (tree, leaf)."""

    def __init__(self, feature, threshold, value, base):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base
        self.depth = int(np.log2(value.shape[1])) if len(value) else 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by vectorised traversal."""
        if not len(self.value):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.value))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: float = 8.0) -> Trees:
    """Boosting on histograms of at most ``bins`` quantile bins; ``least``: hessian a child must keep."""
    n, f = x.shape
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            gain, choice = np.full(count, 1e-6), np.full((count, 2), -1)
            for j in range(f):
                key = local * bins + binned[:, j]
                gs, hs = (np.bincount(key, v, count * bins).reshape(count, bins).cumsum(axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                own = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                own[(hs < least) | (ht - hs < least)] = -1
                best = own.argmax(axis=1)
                top = own[np.arange(count), best]
                better = top > gain
                gain[better] = top[better]
                choice[better] = np.stack([np.full(count, j), best], axis=1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                j, b = choice[k]
                if b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[t, leaf]
    return Trees(feature, threshold, value, base)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def labelled(labels: DataFrame, label: str, modulus: int, held_out: int, at_most: int) -> DataFrame:
    """(doc_id, y) of at most ``at_most`` labelled rows outside the held-out fold, chosen by hash; contradicting and null labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").select("doc_id", F.col("y").cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, at_most: int = 20_000, **params) -> Trees:
    """Fits on the statistics of at most ``at_most`` labelled documents (a bound on what the driver holds)."""

    def run(batches):
        for b in K.chunks(batches):
            x = statistics(*K.offsets_of(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    chosen = F.broadcast(labelled(labels, label, modulus, held_out, at_most))
    made = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(run, "doc_id long, y double, x array<double>")
    table = made.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()  # an id that repeats counts once
    if not table.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y, ids = table.column("y").to_numpy(), table.column("doc_id").to_numpy()
    order = np.lexsort((*x.T, ids))  # the same model whatever order the rows came in
    return fit(x[order], y[order], **params)


def classify(docs: DataFrame, model: Trees, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score double and predicted int of every row of ``docs``.

    Nulls and empty texts have the score of all-zero statistics.  Repeated rows,
    ids and ties are scored alike; an empty table gives no rows.  Only ``keep``
    and ``text`` are read, and of these only ``text`` is an input of the score.
    """
    text = "text" if "text" in keep else "_text"
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for b in K.chunks(batches, text):
            score = model.score(statistics(*K.offsets_of(b.column(text))))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
