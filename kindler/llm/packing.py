"""Best-fit packing by length patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver.  Patterns of few lengths that fill a sequence are enumerated on a coarse
grid, their repeat counts are fitted to the histogram by NNLS and rounded down,
patterns are made exact from the longest lengths at hand with a best-fitting last
piece, and what is left is packed best-fit, longest first.  The plan has at most
one run per length and pattern, so its size does not depend on the corpus;
executors turn (length, rank) into a place by binary search.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import partitions, written

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 0
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[K.SPACES] = _SPACE
_KIND[[*range(48, 58)]] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
#: Bytes that keep a word whole: the apostrophe (contractions), < (special tokens) and leads other than that of U+00C0-U+00FF.
_WHOLE = np.zeros(256, bool)
_WHOLE[[0x27, 0x3C, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


class WordEncoder:
    """Token ids of texts, each distinct unit encoded once.

    For tokenizers that lower-case, drop white space and encode runs of letters,
    single digits and runs of other characters on their own.  Words of ASCII and
    the letters U+00C0-U+00FF are cut into such runs; any other word is one unit.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.reset()

    def reset(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in batch(texts, add_special_tokens=False)]

    def learn(self, hashes, starts, ends, raw, plain) -> None:
        """``plain``: units that are one run of letters; many are encoded as one text and told apart by the word-end tokens."""
        data = raw.tobytes()
        order = np.argsort(~plain, kind="stable")
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = int(plain.sum())
        flat = [np.zeros(0, np.uint32)]
        for a in range(0, n, 4096):
            many = [" ".join(texts[i : min(i + 256, n)]) for i in range(a, min(a + 4096, n), 256)]
            flat += [np.array(ids, np.uint32) for ids in self._encode(many)]
        flat = np.concatenate(flat)
        size = np.diff(np.append(-1, np.flatnonzero(self.is_end[flat]))) if len(flat) else np.zeros(0, np.int64)
        if len(size) != n or size.sum() != len(flat):
            raise ValueError("the tokenizer does not encode runs of letters as single words")
        rest = [np.asarray(ids, np.uint32) for a in range(n, len(texts), 4096) for ids in self._encode(texts[a : a + 4096])]
        size = np.concatenate([size, [len(g) for g in rest]]).astype(np.int64)
        flat = np.concatenate([flat, *rest])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        hashes, at, size = np.concatenate([self.hashes, hashes]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(hashes)
        self.hashes, self.at, self.size = hashes[order], at[order], size[order]

    def units(self, offs, raw):
        """(start, end, hash, plain) of all units."""
        kind = _KIND[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        begin = kind != _SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | edge[1:-1]
        word_start, word_end, _ = K.words_of(offs, raw)
        odd = _WHOLE[raw]
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        start = np.flatnonzero(begin)
        whole = np.zeros(len(start), bool)
        if odd.any():
            bad = np.unique(np.searchsorted(word_start, np.flatnonzero(odd), "right") - 1)
            owner = np.searchsorted(word_start, start, "right") - 1
            whole = np.isin(owner, bad)
            stay = ~whole | (word_start[owner] == start)
            start, whole = start[stay], whole[stay]
        owner = np.searchsorted(word_start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), word_end[owner]) if len(start) else start
        h = K.range_hash(K.byte_sums(raw, folded=True), start, end)
        if whole.any():
            h[whole] = K.range_hash(K.byte_sums(raw), start[whole], end[whole]) ^ np.uint64(0x5DEECE66D)
        return start, end, h, (kind[start] == _LETTER) & ~whole

    def encode(self, offs, raw):
        """(ids of all documents, first id of each document and one more)."""
        start, end, h, plain = self.units(offs, raw)
        first = np.searchsorted(start, offs)
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > self.keep:
            self.reset()
        at = np.searchsorted(self.hashes, unique)
        new = np.append(self.hashes, np.uint64(0))[at] != unique
        new |= at == len(self.hashes)
        if new.any():
            self.learn(unique[new], start[where[new]], end[where[new]], raw, plain[where[new]])
            at = np.searchsorted(self.hashes, unique)
        size, source = self.size[at][inverse], self.at[at][inverse]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(source - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): its ids and ``end_id``, cut only when longer than ``capacity``."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = WordEncoder(tokenizer_path)
        for b in K.chunks(batches, limit=1 << 20):
            ids, bounds = encoder.encode(*K.offsets_of(b.column("text")))
            rows = [[], [], [], [], []]
            for i in range(b.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    for r, v in zip(rows, (i, k // capacity, k, len(part), zlib.crc32(part.tobytes())), strict=True):
                        r.append(v)
            of = pa.array(rows[0], pa.int64())
            yield pa.record_batch([b.column("row_key").take(of), b.column("doc_id").take(of), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=[x.split()[0] for x in PIECES.split(", ")])
        del encoder
        K.give_back()

    docs = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, limit: int = 400) -> np.ndarray:
    """Least squares under x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    tiny = 1e-6 * np.abs(a.T @ b).max(initial=0)
    for _ in range(limit):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        j = int(np.argmax(w))
        if not n or w[j] <= tiny:
            break
        on[j] = True
        while True:
            own = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = np.min(x[own][low] / (x[own][low] - s[low] + 1e-300))
            x[own] += step * (s - x[own])
            on[own[x[own] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


def patterns(bins: int, most: int = 3) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 1 to ``most`` bins that add up to ``bins``."""
    out = []

    def grow(left, cap, part):
        if not left:
            out.append(part)
        elif len(part) < most:
            for x in range(min(left, cap), 0, -1):
                if x * (most - len(part)) >= left:
                    grow(left - x, x, (*part, x))

    grow(bins, bins, ())
    return out


def plan(histogram: np.ndarray, capacity: int, bins: int = 128, most: int = 3) -> list[tuple[list[int], int]]:
    """Runs (lengths of a sequence's pieces in order, repeats) that use up ``histogram`` (index: length)."""
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[list[int], int]] = []
    width = -(-capacity // bins)

    def longest(low: int, high: int) -> int:
        found = np.flatnonzero(left[low : high + 1])
        return low + int(found[-1]) if len(found) else 0

    def take(bounds, repeats: int) -> int:
        """One run: a piece in each of the bounds, then best fits until nothing more fits."""
        lengths, room = [], capacity
        for low, high in bounds:
            own = longest(max(1, low), min(high, room))
            if not own:
                break
            left[own] -= 1
            lengths.append(own)
            room -= own
        if len(lengths) == len(bounds):
            while room and (own := longest(1, room)):
                left[own] -= 1
                lengths.append(own)
                room -= own
        for x in lengths:
            left[x] += 1
        if len(lengths) < len(bounds):
            return 0
        kinds, times = np.unique(lengths, return_counts=True)
        count = int(min(repeats, *(left[k] // t for k, t in zip(kinds, times, strict=True))))
        left[kinds] -= times * count
        runs.append((lengths, count))
        return count

    if left.sum():
        known = patterns(-(-capacity // width), most)
        a = np.zeros((known[0][0], len(known)))
        for j, p in enumerate(known):
            np.add.at(a[:, j], np.array(p) - 1, 1)
        binned = np.zeros(len(a))
        np.add.at(binned, (np.arange(1, capacity + 1) - 1) // width, left[1 : capacity + 1])
        repeats = np.floor(nnls(a, binned)).astype(np.int64)
        for j in np.argsort([-p[0] for p in known], kind="stable"):
            todo = int(repeats[j])
            bounds = [((k - 1) * width + 1, k * width) for k in known[j]]
            bounds = bounds[:-1] if len(bounds) > 1 else bounds  # the last piece is the best fit
            while todo and (done := take(bounds, todo)):
                todo -= done
        while left.sum():
            take([(1, capacity)], 2**62)
    return runs


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id long and offset long: gapless from 0 in each sequence of at most ``capacity``.

    Rows are returned as often as they come; ids may be null or repeated.  An
    empty table gives no rows.
    """
    cut = written(cut)
    spark = cut.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["count"]
    slots, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, count in plan(histogram, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, int(used[x]), base, offset))
            used[x] += count
            offset += x
        base += count
    slots = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = (slots[:, 0] << 44) + slots[:, 1]
    # ranks within a length: salted, so that a common length is not one group
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece", "doc_id"), F.lit(max(64, 2 * partitions(spark)))))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key", "piece")))
    ranked = ranked.join(sums.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
