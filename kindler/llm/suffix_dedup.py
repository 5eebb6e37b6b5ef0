"""Substring dedup with prefix-partitioned suffix trees.

Runs of windows that may repeat (see ``repeats``) travel with their words to the
bucket of their anchor, so equal windows meet.  There the suffixes that start a
window are split by prefixes of variable length into groups of bounded size; a
prefix that has too many suffixes is made longer.  Each group becomes a suffix
tree, held as sorted leaves and the depths between neighbours, which are read
word by word.  An internal node of at least a window's depth is a repeat; the
deepest one above a leaf says how many words of the leaf's suffix are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkernel as K
from .common import buckets, keyed, split_by_bucket

#: Leaves of a subtree, at most (unless more suffixes share a whole window).
GROUP = 200_000
_HEAD = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "u1"), ("known", "u1")])
_MARK = np.dtype([("start", "<u4"), ("n", "<u4")])


class Words:
    """Words of spans as numbers (from 1; 0 ends a span), and strips of a few words as ranks.

    ``strip[p]`` is the rank of the ``k`` words at ``p``, nothing beyond the end
    of the span, so strips compare as the words do.
    """

    def __init__(self, symbol: np.ndarray, size: np.ndarray):
        """``symbol``: numbers of all words from 1; ``size``: words of each span."""
        n = len(symbol) + len(size)
        self.begin = np.cumsum(size + 1) - size - 1
        self.at = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.begin + size] = False
        self.at[inner] = symbol
        self.rest = np.repeat(self.begin + size, size + 1) - np.arange(n)
        bits = max(1, int(symbol.max()).bit_length() if len(symbol) else 1)
        self.k = max(1, min(4, 63 // bits))
        code, ahead = np.zeros(n, np.int64), np.append(self.at, np.zeros(self.k, np.int64))
        for i in range(self.k):
            code = (code << bits) | np.where(self.rest > i, ahead[i : i + n], 0)
        self.strip = np.unique(code, return_inverse=True)[1]
        self.bits = max(1, n.bit_length())

    @classmethod
    def of(cls, data: bytes, size: np.ndarray) -> Words:
        """Words of ``data``, each followed by one space, numbered by their bytes; ``size`` of them in each span."""
        raw = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(raw == 32)
        offs = np.append(0, space - np.arange(len(space)))
        array = pa.Array.from_buffers(pa.large_binary(), len(space), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(raw[raw != 32])])
        return cls(array.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, size)

    def ahead(self, at: np.ndarray, depth) -> np.ndarray:
        """The strip ``depth`` words after each position; 0 behind the span's end."""
        return self.strip[at + np.minimum(depth, self.rest[at])]

    def groups(self, leaves: np.ndarray, size: int, most: int):
        """``leaves`` split by prefixes, short of ``size`` words, into arrays of at most ``most``."""
        open_ = [(leaves, 0)]
        while open_:
            own, depth = open_.pop()
            if len(own) <= most or depth + self.k > size:
                yield own
                continue
            key = self.ahead(own, depth)
            order = np.argsort(key, kind="stable")
            own, edges = own[order], R.cut(key[order])
            a = 0
            while a < len(own):
                b = int(edges[np.searchsorted(edges, a + most, "right") - 1])
                if b > a:  # neighbouring prefixes together
                    yield own[a:b]
                else:  # one prefix with too many suffixes: a longer one
                    b = int(edges[np.searchsorted(edges, a, "right")])
                    open_.append((own[a:b], depth + self.k))
                a = b


class Subtree:
    """The suffix tree of some suffixes: ``leaves`` in order and ``depth`` between each leaf and the next, in words."""

    def __init__(self, words: Words, leaves: np.ndarray):
        n, k = len(leaves), words.k
        at, new, floor = leaves.copy(), np.append(True, np.zeros(max(0, n - 1), bool))[:n], np.zeros(n, np.int64)
        per = max(1, 62 // words.bits)
        tied, depth = np.arange(n if n > 1 else 0), 0
        while len(tied):
            own = at[tied]
            key = words.ahead(own, depth)
            for i in range(1, per):
                key = (key << words.bits) | words.ahead(own, depth + i * k)
            group = np.cumsum(new[tied])
            order = np.lexsort((key, group))
            at[tied], key = own[order], key[order]  # groups are contiguous, so each leaf stays in its own
            fresh = np.append(False, key[1:] != key[:-1]) & ~new[tied]
            new[tied[fresh]], floor[tied[fresh]] = True, depth
            depth += per * k
            alone = new & np.append(new[1:], True)
            tied = tied[~alone[tied]]
            if len(tied):  # a group whose suffixes have all ended is final
                bounds = np.flatnonzero(new[tied])
                longest = np.maximum.reduceat(words.rest[at[tied]], bounds)
                tied = tied[np.repeat(longest > depth, np.diff(np.append(bounds, len(tied))))]
        self.words, self.leaves = words, at
        a, b = at[:-1], at[1:]
        short = np.minimum(words.rest[a], words.rest[b])
        self.depth = np.where(new[1:], np.minimum(floor[1:], short), short)
        live = np.flatnonzero(new[1:])
        while len(live):  # strips, then words, from the depth where the two were last known to agree
            d = self.depth[live]
            same = (words.ahead(a[live], d) == words.ahead(b[live], d)) & (short[live] >= d + k)
            self.depth[live[same]] += k
            part = live[~same]
            for _ in range(k - 1):
                d = self.depth[part]
                part = part[(d < short[part]) & (words.at[a[part] + np.minimum(d, short[part])] == words.at[b[part] + np.minimum(d, short[part])])]
                self.depth[part] += 1
            live = live[same]

    def deepest(self) -> np.ndarray:
        """Depth of each leaf's parent: the most words that its suffix shares with another one."""
        return np.maximum(np.append(0, self.depth), np.append(self.depth, 0))[: len(self.leaves)]

    def nodes(self, least: int):
        """(depth, first leaf, last leaf) of the internal nodes at least ``least`` words deep: the repeats that no longer one always follows."""
        open_: list = []
        for i, d in enumerate([*self.depth.tolist(), 0]):
            first = i
            while open_ and open_[-1][0] > d:
                depth, first = open_.pop()
                if depth >= least:
                    yield depth, first, i
            if not open_ or open_[-1][0] < d:
                open_.append((d, first))


def repeated(words: Words, size: int, most: int) -> np.ndarray:
    """True at the words under a window of ``size`` words that starts at least twice."""
    delta = np.zeros(len(words.at) + 1, np.int32)
    for leaves in words.groups(np.flatnonzero(words.rest >= size), size, most):
        tree = Subtree(words, leaves)
        depth = tree.deepest()
        deep = depth >= size
        delta[tree.leaves[deep]] += 1  # leaves are distinct
        np.add.at(delta, tree.leaves[deep] + depth[deep], -1)
    return np.cumsum(delta[:-1]) > 0


def canonical(items: R.Items):
    """(words of the chunk, each followed by one space, and the place of each in it)."""
    size = items.end - items.start
    place = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[place + size] = False
    out[inner] = items.raw[~K.SPACES[items.raw]]
    return out.tobytes(), np.append(place, len(out))


def repeated_spans(docs: DataFrame, size: int, gram: int, group: int = GROUP) -> DataFrame:
    """(row_key, marks binary of (start, words)): runs of words under windows of ``size`` words that also start elsewhere."""
    n = buckets(docs)
    hot = R.crowded(docs, "word", size, gram, n)

    def marks(keys, start, length):
        pairs = np.zeros(len(keys), _MARK)
        pairs["start"], pairs["n"] = start, length
        return R.by_key(keys, pairs, n)

    def send(bucket, keys, start, length, texts):
        # equal spans of the flush are repeats of each other: one of them goes on
        lead: dict = {}
        first = np.array([lead.setdefault(t, i) for i, t in enumerate(texts)])
        again = np.bincount(first, minlength=len(first))[first] > 1
        if again.any():
            yield marks(keys[again], start[again], length[again] + size - 1)
        keep = np.flatnonzero(first == np.arange(len(first)))
        out, a, b = [], [], []
        for x, (own,) in split_by_bucket(bucket[keep], n, keep):
            table, row = np.unique(keys[own], return_inverse=True)
            head = np.zeros(len(own), _HEAD)
            head["row"], head["start"], head["n"], head["known"] = row, start[own], length[own], again[own]
            out.append(x)
            a.append(R.squeezed(b"".join([texts[i] for i in own.tolist()])))
            b.append(np.array([len(table)], "<i8").tobytes() + table.tobytes() + R.squeezed(head.tobytes()))
        yield R.moved(out, [0] * len(out), a, b)

    def spans(batches):
        held, texts, count = [], [], 0
        for c in K.chunks(batches, limit=R.CHUNK["word"]):
            items = R.Items(c.column("text"), "word")
            at, length, anchor = R.wanted_runs(items, c, size, gram)
            if not len(at):
                continue
            single = hot[(anchor % np.uint64(len(hot))).astype(np.int64)]
            at, length, deal, single = R.pieces(at, length, anchor, single)
            deal[single] = items.windows(size)[at[single]]  # windows of a crowded anchor travel singly, by all their words
            data, place = canonical(items)
            texts += [data[x:y] for x, y in zip(place[at].tolist(), place[at + length + size - 1].tolist(), strict=True)]
            row = K.owner(items.first, at)
            held.append((((deal >> np.uint64(32)) % np.uint64(n)).astype(np.int64), c.column("row_key").to_numpy(zero_copy_only=False)[row], at - items.first[row], length))
            count += len(at)
            if count >= R.FLUSH // 8:
                yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)), texts)
                held, texts, count = [], [], 0
        if count:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)), texts)

    def subtrees(batches):
        heads, keys, texts = [], [], []
        for batch in batches:
            yield batch.filter(batch.column("b").is_null())  # answers on their way
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if b is None:
                    continue
                m = int(np.frombuffer(b, "<i8", 1)[0])
                head = np.frombuffer(R.opened(b[8 + 8 * m :]), _HEAD)
                heads.append(head)
                keys.append(np.frombuffer(b, "<i8", m, 8)[head["row"]])
                texts.append(R.opened(a))
        if not heads:
            return
        head, keys = np.concatenate(heads), np.concatenate(keys)
        words = Words.of(b"".join(texts), head["n"].astype(np.int64) + size - 1)
        del texts, heads
        span, a, b = R.spans_of(repeated(words, size, group), np.append(words.begin, len(words.at)))
        asked = head["known"][span] == 0
        span, a, b = span[asked], a[asked], b[asked]
        yield marks(keys[span], head["start"][span] + a, b - a)

    likely = R.join_rows(docs, R.repeated_anchors(docs, "word", size, gram, across=False), "inner")
    sent = likely.mapInArrow(spans, R.MOVED)
    return R.gathered(sent.repartitionById(n, F.col("bucket")).mapInArrow(subtrees, R.MOVED), "marks", 8, n)


def dedup(documents: DataFrame, size: int = 35, gram: int = 12, carry: Column | None = None, verbatim: bool = False) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words long, spans array<struct<start, end>>, kept string.

    ``spans`` are the maximal runs of words covered by windows of ``size`` words
    that also start anywhere else, in the same row or another; ``kept`` has the
    other words, joined by one space.  Null and empty texts have no words.  Rows
    that repeat doc_id and text are repeats of each other; rows that share only
    the id, or have none, are rows like any other.  Texts shorter than a window
    lose nothing, however often they occur.  An empty table gives no rows; other
    columns are not read, but ``carry`` (say a struct of them) is returned as it is.
    ``verbatim``: texts without repeats are kept as they are, white space included.
    """
    docs = keyed(documents, (F.lit(None).cast("string") if carry is None else carry).alias("carry"))

    def finish(batches):
        for c in K.chunks(batches, limit=R.CHUNK["word"]):
            items = R.Items(c.column("text"), "word")
            n = c.num_rows
            own = [np.frombuffer(x or b"", "<u4").reshape(-1, 2).astype(np.int64) for x in c.column("marks").to_pylist()]
            every = np.concatenate(own) if own else np.zeros((0, 2), np.int64)
            words = len(items.start)
            gone = R.cover(words, every[:, 0] + np.repeat(items.first[:-1], [len(x) for x in own]), every[:, 1])
            keep = ~gone
            row = np.repeat(np.arange(n), np.diff(items.first))
            # bytes of kept words, and the byte behind each one that is not the row's last, as a space
            raw = items.raw.copy()
            delta = np.zeros(len(raw) + 1, np.int32)
            k = np.flatnonzero(keep)
            more = np.zeros(len(k), np.int64)
            if len(k):
                more[:-1] = row[k[1:]] == row[k[:-1]]
                raw[items.end[k][more > 0]] = 32
            np.add.at(delta, items.start[k], 1)
            np.add.at(delta, items.end[k] + more, -1)
            mask = np.cumsum(delta[:-1]) > 0
            size_of = np.bincount(row[k], items.end[k] - items.start[k] + more, n).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(size_of)]).astype(np.int32)
            text = pa.StringArray.from_buffers(n, pa.py_buffer(offs), pa.py_buffer(raw[mask]))
            if verbatim:
                changed = np.bincount(row, gone, n) > 0 if words else np.zeros(n, bool)
                text = pc.if_else(pa.array(changed), text, c.column("text"))
            yield pa.record_batch([c.column("doc_id"), c.column("carry"), pa.array(np.diff(items.first)), R.span_array(*R.spans_of(gone, items.first), n), text], names=["doc_id", "carry", "n_words", "spans", "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = R.join_rows(docs, repeated_spans(docs, size, gram), "left")
    made = rows.select("doc_id", "carry", "text", "marks").mapInArrow(finish, f"doc_id {kinds['doc_id']}, carry {kinds['carry']}, n_words long, spans array<struct<start:int,end:int>>, kept string")
    return made.drop("carry") if carry is None else made
