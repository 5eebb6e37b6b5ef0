"""Token ids of texts, cut into units that tokenizers encode independently; each distinct unit of a task is encoded once."""

from __future__ import annotations

import json

import numpy as np

from . import textkernel as K

#: Units whose ids a task remembers before it starts anew.
KEEP = 400_000


class UnitCache:
    """Ids of byte ranges by a 64-bit hash of the bytes.

    ``encode`` gives the ids of a string in an array, ``width`` the bytes of every
    id.  New units are encoded many at once, as one string: their ids are told
    apart by their bytes.  Two units of a task that share a hash would share their
    ids: at ``KEEP`` units the chance is about 4e-9.
    """

    def __init__(self, encode, width: np.ndarray, keep: int = KEEP):
        self.encode, self.width, self.keep = encode, width, keep
        self.reset()

    def reset(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, hashes: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> None:
        """``alone``: units that must not be followed by another one."""
        order = np.argsort(alone, kind="stable")
        hashes, start, end = hashes[order], start[order], end[order]
        whole = len(order) - int(alone.sum())
        groups = [(i, min(i + 512, whole)) for i in range(0, whole, 512)] + [(i, i + 1) for i in range(whole, len(order))]
        x, y = start.tolist(), end.tolist()
        found = [self.encode(b"".join([data[x[k] : y[k]] for k in range(i, j)]).decode()) for i, j in groups]
        flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(self.width[flat])])
        edges = np.concatenate([[0], np.cumsum(end - start)])
        at = np.searchsorted(ends, edges)
        if not np.array_equal(ends[np.minimum(at, len(ends) - 1)], edges):
            raise ValueError("a token crosses the border of two units")
        size, at = np.diff(at), at[:-1] + self.used
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        hashes, at, size = np.concatenate([self.hashes, hashes]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(hashes)
        self.hashes, self.at, self.size = hashes[order], at[order], size[order]

    def ids(self, raw: np.ndarray, start: np.ndarray, alone: np.ndarray):
        """(ids of the units one after the other, number of ids of each unit); a unit ends where the next one starts."""
        end = np.append(start[1:], len(raw))[: len(start)]
        if len(self.hashes) > self.keep or self.used > 8 * self.keep:
            self.reset()
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        unique, where, inverse = np.unique(K.range_hash(K.byte_sums(raw), start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != unique if len(self.hashes) else np.ones(len(unique), bool)
        if new.any():
            own = where[new]
            self.learn(unique[new], raw.tobytes(), start[own], end[own], alone[own])
            at = np.searchsorted(self.hashes, unique)
        size = self.size[at][inverse]
        return ranges(self.pool, self.at[at][inverse], size), size


def ranges(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of every range, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return pool[at]


def pooled(entries: list[bytes]):
    """(bytes of all entries, start and size of each)."""
    size = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


def ends_with(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """True at i where the bytes before i end with ``mark``; one entry more than bytes."""
    out = np.zeros(len(raw) + 1, bool)
    n = len(mark)
    if len(raw) >= n:
        hit = raw[n - 1 :] == mark[-1]
        for k in range(n - 1):
            hit &= raw[k : len(raw) - n + 1 + k] == mark[k]
        out[n:] = hit
    return out


#: White space beyond ASCII (the Unicode property).
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class ByteLevelEncoder:
    """Ids of a byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    The file's tokens must be the 256 bytes and then one for each merge, in their
    order, so that ids are ranks.  No unit of the splitting pattern has white space
    after other characters, and what follows such a place is split alike without
    what precedes it: texts are cut there.  Every text begins with a space.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(plain)))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][t] >= 256 for t in byte_of) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{path} is not a byte-level file whose ids are ranks")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        coder = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [x for x, _ in sorted(ranks.items(), key=lambda e: e[1])]
        self.cache = UnitCache(lambda text: coder.encode_to_numpy(text, disallowed_special=()).astype(np.int32), np.array([len(x) for x in self.bytes], np.int64))

    def encode(self, offs: np.ndarray, raw: np.ndarray):
        """(ids, first id of each document and one more)."""
        blank = K.SPACES[raw]
        after = np.zeros(len(raw) + 1, bool)
        after[1:] = blank
        for mark in WIDE_SPACES:
            if (raw == mark[0]).any():
                after |= ends_with(raw, mark)
        begin = blank & ~after[:-1]
        begin[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(begin)
        # white space that ends a text is split by what follows
        alone = ~blank[start] | after[np.append(start[1:], len(raw))[: len(start)]]
        ids, size = self.cache.ids(raw, start, alone)
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offs)]
