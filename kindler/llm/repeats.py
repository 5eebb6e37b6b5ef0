"""Candidates for long exact repeats, found without comparing texts.

Items are words or bytes; a window is ``size`` consecutive items of one row.
The anchor of a window is the least hash among its grams of ``gram`` items (a
minimizer), so equal windows have equal anchors.  A window whose anchor occurs
once in the corpus cannot repeat; one hash for each run of windows with the same
anchor is shuffled to find the others.

Records are grouped into one blob for each (flush, bucket), so Spark moves few
rows.  Equal records of a flush are combined first: however frequent a passage
is, a flush sends it once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import buckets, split_by_bucket

#: Records that a task holds before it sends them.
FLUSH = 600_000
#: Bytes of a chunk: arrays of one number for each item stay in the cache.
CHUNK = {"word": 1 << 19, "byte": 1 << 17}
_LOW = np.uint64(2**32 - 1)
_KNOWN = np.uint16(65535)  # a leader whose own answer is already known
MOVED = "bucket int, row_key long, a binary, b binary"


class Items:
    """Words or bytes of a chunk, the first item of each row and window hashes."""

    def __init__(self, column, unit: str):
        self.offs, self.raw = K.offsets_of(column)
        self.unit = unit
        if unit == "word":
            self.start, self.end, self.first = K.words_of(self.offs, self.raw)
            self.hashes = K.range_hash(K.byte_sums(self.raw), self.start, self.end)
        else:
            self.first, self.sums = self.offs, K.byte_sums(self.raw)

    def windows(self, size: int) -> np.ndarray:
        if self.unit == "word":
            return K.windows_hash(self.hashes, size)
        n = len(self.raw) - size + 1
        return K.range_hash(self.sums, slice(0, n), slice(size, None)) if n > 0 else np.zeros(0, np.uint64)

    def anchors(self, size: int, gram: int):
        """(anchor of every window, whether the window lies in one row)."""
        valid = K.inside(self.first, size)
        return K.sliding(np.minimum, self.windows(gram), size - gram + 1)[: len(valid)], valid


def runs(anchor: np.ndarray, valid: np.ndarray, first: np.ndarray):
    """(start, length) of maximal runs of valid windows of one row with one anchor."""
    n = len(valid)
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    new[first[first < n]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    return at[valid[at]], length[valid[at]]


def twice(grams: np.ndarray, at: np.ndarray, length: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Runs in whose grams the anchor stands more than once, as in periodic text."""
    if not len(at):
        return np.zeros(0, bool)
    span = length + width - 1
    bounds = np.cumsum(span) - span
    own = np.repeat(at - bounds, span) + np.arange(int(span.sum()))
    return np.add.reduceat((grams[own] == np.repeat(anchor, span)).astype(np.int32), bounds) > 1


def compact(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket (of n) and 32 bits within it: enough for a filter, as buckets grow with the corpus."""
    return (((h >> np.uint64(32)) % np.uint64(n)) << np.uint64(32)) | (h & _LOW)


def moved(bucket, row_key, a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(row_key, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "row_key", "a", "b"])


def cut(order_key: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length at the end."""
    if not len(order_key):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, order_key[1:] != order_key[:-1])), len(order_key))


def by_key(keys: np.ndarray, values: np.ndarray, n: int):
    """One batch of blobs: keys and their values (fixed width), by the bucket of the key."""
    made = list(split_by_bucket((keys.view(np.uint64) % np.uint64(n)).astype(np.int64), n, keys, values))
    return moved([x for x, _ in made], [0] * len(made), [k.tobytes() + np.ascontiguousarray(v).tobytes() for _, (k, v) in made], [None] * len(made))


def gathered(found: DataFrame, name: str, width: int, n: int) -> DataFrame:
    """(row_key, ``name`` binary): all values of ``width`` bytes that ``by_key`` blobs hold for a key, in one row."""

    def merge(batches):
        keys, values = [], []
        for batch in batches:
            for a in batch.column("a").to_pylist():
                m = len(a) // (8 + width)
                keys.append(np.frombuffer(a, np.int64, m))
                values.append(np.frombuffer(a, f"V{width}", m, 8 * m))
        if not keys:
            return
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        edges = cut(keys)
        for x in range(0, len(edges) - 1, 5000):
            part = edges[x : x + 5001].tolist()
            yield pa.record_batch([pa.array(keys[part[:-1]]), pa.array([values[i:j].tobytes() for i, j in zip(part[:-1], part[1:], strict=True)], pa.binary())], names=["row_key", name])

    return found.repartitionById(n, F.col("bucket")).mapInArrow(merge, f"row_key long, {name} binary")


def pack_keys(own_keys: np.ndarray):
    """(table of distinct keys, index of each): shared by the records of a blob."""
    table, index = np.unique(own_keys, return_inverse=True)
    return table, index.astype(np.uint16 if len(table) < 65535 else np.uint32)


def send_anchors(h: np.ndarray, keys: np.ndarray, n: int, across: bool):
    """Batches of one flush of (anchor, row_key) pairs: answers known at once, and leaders for the buckets."""
    order = np.lexsort((keys, h))
    h, keys = h[order], keys[order]
    if across:
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])
        h, keys = h[fresh], keys[fresh]
    same = h[1:] == h[:-1]
    again, lead = np.append(False, same) | np.append(same, False), np.append(True, ~same)
    if again.any():
        yield by_key(keys[again], (h[again] & _LOW).astype("<u4"), n)
    h, keys, again = h[lead], keys[lead], again[lead]
    buckets, a, b = [], [], []
    for bucket, (x, k, g) in split_by_bucket((h >> np.uint64(32)).astype(np.int64), n, (h & _LOW).astype("<u4"), keys, again):
        table, index = pack_keys(k[~g])
        whole = np.full(len(x), _KNOWN, index.dtype)
        if index.dtype == np.uint32:
            whole[:] = np.uint32(0xFFFFFFFF)
        whole[~g] = index
        buckets.append(bucket)
        a.append(x.tobytes())
        b.append(np.array([len(table), whole.itemsize], "<i8").tobytes() + table.astype("<i8").tobytes() + whole.tobytes())
    yield moved(buckets, [0] * len(buckets), a, b)


def open_blob(b: bytes):
    """(table of keys, index of each record or the largest value where none is wanted)."""
    size, width = np.frombuffer(b, "<i8", 2)
    return np.frombuffer(b, "<i8", size, 16), np.frombuffer(b, np.uint16 if width == 2 else np.uint32, -1, 16 + 8 * int(size))


def repeated_anchors(docs: DataFrame, unit: str, size: int, gram: int, across: bool) -> DataFrame:
    """(row_key, anchors binary of uint32): anchors of a row that occur elsewhere too.

    ``across``: only occurrences in other rows count.
    """
    n = buckets(docs)

    def emit(batches):
        held, count = [], 0
        for c in K.chunks(batches, limit=CHUNK[unit]):
            items = Items(c.column("text"), unit)
            anchor, valid = items.anchors(size, gram)
            at, length = runs(anchor, valid, items.first)
            keys = c.column("row_key").to_numpy(zero_copy_only=False)
            if not across:  # an anchor that repeats inside its run counts twice
                self_ = twice(items.windows(gram), at, length, anchor[at], size - gram + 1)
                at = np.concatenate([at, at[self_]])
            held.append((compact(anchor[at], n), keys[K.owner(items.first, at)]))
            count += len(at)
            if count >= FLUSH:
                yield from send_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)), n, across)
                held, count = [], 0
        if count:
            yield from send_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)), n, across)

    def answer(batches):
        low, keys, asked = [], [], []
        for batch in batches:
            yield batch.filter(batch.column("b").is_null())  # answers on their way
            for bucket, a, b in zip(*(batch.column(i).to_pylist() for i in ("bucket", "a", "b")), strict=True):
                if b is None:
                    continue
                table, index = open_blob(b)
                known = index == np.iinfo(index.dtype).max
                low.append(np.frombuffer(a, "<u4").astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)))
                keys.append(np.append(table, 0)[np.where(known, len(table), index)])
                asked.append(~known)
        if not low:
            return
        low, keys, asked = np.concatenate(low), np.concatenate(keys), np.concatenate(asked)
        order = np.lexsort((keys, low)) if across else np.argsort(low, kind="stable")
        low, keys, asked = low[order], keys[order], asked[order]
        if across:  # rows that repeat id and text meet here under one key
            fresh = np.ones(len(low), bool)
            fresh[1:] = (low[1:] != low[:-1]) | (keys[1:] != keys[:-1]) | ~asked[1:] | ~asked[:-1]
            low, keys, asked = low[fresh], keys[fresh], asked[fresh]
        same = low[1:] == low[:-1]
        hit = (np.append(False, same) | np.append(same, False)) & asked
        yield by_key(keys[hit], (low[hit] & _LOW).astype("<u4"), n)

    sent = docs.select("row_key", "text").mapInArrow(emit, MOVED)
    return gathered(sent.repartitionById(n, F.col("bucket")).mapInArrow(answer, MOVED), "anchors", 4, n)


def join_rows(docs: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with their answers; the answers are the build side, so texts are not sorted."""
    return docs.join(answers.hint("shuffle_hash"), "row_key", how)


def wanted_runs(items: Items, batch: pa.RecordBatch, size: int, gram: int):
    """(start, length, anchor) of the chunk's runs of windows whose anchor is among the row's ``anchors``."""
    anchor, valid = items.anchors(size, gram)
    at, length = runs(anchor, valid, items.first)
    lists = batch.column("anchors").to_pylist()
    wanted = [np.frombuffer(own or b"", "<u4") for own in lists]
    row = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]).astype(np.uint64)
    tag = lambda r, h: K.mix(h * np.uint64(0x9E3779B97F4A7C15) + r)
    good = np.unique(tag(row, np.concatenate(wanted).astype(np.uint64))) if wanted else np.zeros(0, np.uint64)
    mine = tag(K.owner(items.first, at).astype(np.uint64), anchor[at] & _LOW)
    where = np.minimum(np.searchsorted(good, mine), max(0, len(good) - 1))
    hit = good[where] == mine if len(good) else np.zeros(len(mine), bool)
    return at[hit], length[hit], anchor[at[hit]]


def candidates(items: Items, batch: pa.RecordBatch, size: int, gram: int) -> np.ndarray:
    """True at windows of the chunk whose anchor is among the row's ``anchors``."""
    at, length, _ = wanted_runs(items, batch, size, gram)
    delta = np.zeros(max(0, int(items.first[-1]) - size + 1) + 1, np.int32)
    delta[at] += 1
    delta[at + length] -= 1
    return np.cumsum(delta[:-1]) > 0


#: Runs of windows that one gram may have before its windows travel singly, at least.
CROWD = 100_000


def crowded(docs: DataFrame, unit: str, size: int, gram: int, n: int) -> np.ndarray:
    """Which cells of grams have far more than their share of runs, by a table with 16 cells for each of ``n`` buckets.

    Cells are counted by range on the executors; only the crowded ones, fewer
    than four of each range, come to the driver.
    """
    cells = 1 << max(14, (16 * n - 1).bit_length())
    ranges = min(n, 1 << 10)
    wide = -(-cells // ranges)

    def count(batches):
        total = np.zeros(cells, np.int32)
        for c in K.chunks(batches, limit=CHUNK[unit]):
            items = Items(c.column("text"), unit)
            anchor, valid = items.anchors(size, gram)
            at, _ = runs(anchor, valid, items.first)
            total += np.bincount((anchor[at] % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.int32)
        hit = np.flatnonzero(total)
        made = list(split_by_bucket(hit // wide, ranges, hit.astype("<u4"), total[hit].astype("<i4")))
        yield moved([x for x, _ in made], [0] * len(made), [c.tobytes() for _, (c, _) in made], [k.tobytes() for _, (_, k) in made])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for r, a, b in zip(*(batch.column(i).to_pylist() for i in ("bucket", "a", "b")), strict=True):
                own = total.setdefault(r, np.zeros(wide, np.int64))
                own[np.frombuffer(a, "<u4") - r * wide] += np.frombuffer(b, "<i4")
        over = {r: np.flatnonzero(own > max(CROWD, 4 * own.mean())) + r * wide for r, own in total.items()}
        over = {r: x for r, x in over.items() if len(x)}
        yield moved(list(over), [0] * len(over), [x.astype("<u4").tobytes() for x in over.values()], [None] * len(over))

    found = docs.select("text").mapInArrow(count, MOVED).repartitionById(ranges, F.col("bucket")).mapInArrow(add, MOVED)
    out = np.zeros(cells, bool)
    for row in found.select("a").collect():
        out[np.frombuffer(row["a"], "<u4")] = True
    return out


def pieces(at: np.ndarray, length: np.ndarray, group: np.ndarray, single: np.ndarray, most: int = 255):
    """Runs cut into pieces of at most ``most`` windows, and of one window where ``single``: (start, length, group, single)."""
    step = np.where(single, 1, most)
    parts = -(-length // step)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    step, length = np.repeat(step, parts), np.repeat(length, parts)
    return np.repeat(at, parts) + step * k, np.minimum(step, length - step * k), np.repeat(group, parts), np.repeat(single, parts)


def spans_of(mask: np.ndarray, first: np.ndarray):
    """(row, start in the row, end in the row) of maximal runs of True inside each row's items."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[first[first <= n]] = True
    before, after = np.append(False, mask[:-1]), np.append(mask[1:], False)
    a = np.flatnonzero(mask & (~before | edge[:n]))
    b = np.flatnonzero(mask & (~after | edge[1 : n + 1])) + 1
    row = K.owner(first, a)
    return row, a - first[row], b - first[row]


def cover(n_items: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mask of items in any [start, start + length)."""
    delta = np.zeros(n_items + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + length, n_items), -1)
    return np.cumsum(delta[:-1]) > 0


def span_array(row, a, b, n_rows: int) -> pa.Array:
    """array<struct<start, end>> for each row."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["start", "end"]))


def squeezed(blob: bytes) -> bytes:
    """Compressed text, by Zstandard where it is installed."""
    try:
        import zstandard
    except ImportError:
        return b"d" + zlib.compress(blob, 1)
    return b"z" + zstandard.ZstdCompressor(level=3).compress(blob)


def opened(blob: bytes) -> bytes:
    if blob[:1] == b"d":
        return zlib.decompress(blob[1:])
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob[1:])
