"""Vectorised text kernels over Arrow string buffers.

A chunk is a run of whole documents.  Bytes are hashed by prefix sums of a
polynomial modulo 2**64, so the hash of any byte range is two look-ups; words
and windows are found with array operations only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_Q = 0xD1342543DE82EF95
_Q_INV = pow(_Q, -1, 2**64)

#: Separators of words: space and the five controls 0x09-0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _pow or len(_pow[base]) < n + 1:
        _pow[base] = _powers(base, max(n, 1 << 16) * 5 // 4)
    return _pow[base][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def chunks(batches, column: str = "text", limit: int = 2 << 20):
    """Record batches cut into runs of whole documents of about ``limit`` bytes; a longer document stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = offsets_of(batch.column(column))[0]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def offsets_of(array: pa.Array):
    """(offsets, bytes) of a string or binary array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    _, where, data = array.buffers()
    if where is None or len(array) == 0:
        return np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw


def byte_sums(raw: np.ndarray, folded: bool = False) -> np.ndarray:
    """Prefix sums from which ``range_hash`` reads the hash of any byte range."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum((_FOLDED if folded else _BYTE)[raw] * powers(_P, len(raw))[:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start, end) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_P_INV, len(sums))[start])


def words_of(offs: np.ndarray, raw: np.ndarray, sep: np.ndarray = SPACES):
    """(start, end, first): byte range of every word, and the index of each document's first word (one more at the end)."""
    n = len(raw)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = sep[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    inside = ~gap[1:-1]
    start = np.flatnonzero(inside & (gap[:n] | edge[:n]))
    end = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def windows_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes (document borders not regarded)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(_Q, len(words))[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(_Q_INV, len(words))[:n])


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """True at the starts of windows of ``size`` items that stay in one document."""
    n = int(first[-1])
    out = np.zeros(max(0, n - size + 1), bool)
    delta = np.zeros(n + 2, np.int32)
    a, b = first[:-1], np.maximum(first[:-1], first[1:] - size + 1)
    np.add.at(delta, a, 1)
    np.add.at(delta, b, -1)
    out[:] = np.cumsum(delta)[: len(out)] > 0
    return out


def owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


def sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over every run of ``w`` values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[:-step], out[step:]) if step < len(out) else out[:0]
        have += step
    return out


def give_back() -> None:
    """Returns freed memory of this worker process to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
