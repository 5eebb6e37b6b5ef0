"""Suffix-array dedup with a run-length index (r-index).

Windows that may repeat (see ``repeats``) travel as spans: runs of windows with
one partition gram, so equal windows meet in one bucket, and only spans of one
gram can share a window.  The distinct spans of a gram are ranked by their least
doc_id.  For each bit of the rank, the spans that have it unset are indexed (a
run-compressed Burrows-Wheeler transform with suffix-array samples at both ends
of every run) and the spans that have it set are streamed through the index from
right to left, all at once; their matching statistics say how many bytes from
each start occur in a span of a smaller doc_id.  Two spans whose ranks differ are
on different sides exactly at the highest bit in which they differ; their higher
bits, which agree, are part of the alphabet, so nothing else matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkernel as K
from .common import buckets, keyed, split_by_bucket

#: Bytes of distinct spans whose grams are indexed together.
SLICE = 1 << 21
_PER = 7  # symbols of 9 bits in a packed code
_LOWEST = np.array([1 << (9 * i) for i in range(_PER)])
_HEAD = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "u1"), ("gram", "<u4")])
_MARK = np.dtype([("start", "<u4"), ("n", "<u4")])


class RunLengthIndex:
    """r-index of spans of bytes; spans of different ``block`` share no symbol, so they do not match.

    Kept are the runs of the transform (symbol, first row, samples at both ends,
    step of the last-to-first mapping) and the text, seven bytes to a number, for
    comparing two of its suffixes.  A separator ends each span; separators are
    ordered by position, so suffixes are totally ordered.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, block: np.ndarray):
        ends = np.cumsum(size + 1)
        n = self.n = int(ends[-1])
        inner = np.ones(n, bool)
        inner[ends - 1] = False
        plain, wide = np.zeros(n, np.int64), np.zeros(n, np.int64)
        plain[inner] = data.astype(np.int64) + 1
        wide[inner] = self.symbols(data, size, block)
        self.begin = ends - size - 1
        self.rest = (np.repeat(ends, size + 1) - np.arange(n)).astype(np.int32)  # symbols up to and with the separator
        self.codes = self._codes(_PER, plain, 9)
        used = np.zeros(int(wide.max()) + 1, bool)
        used[wide] = True
        self.dense = np.where(used, np.cumsum(used) - 1, -1)  # separators stay 0
        text = self.dense[wide]
        sa = self._sort(text)
        bwt = text[sa - 1]  # position -1 is the last separator
        heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        stop = np.append(heads[1:], n)
        self.symbol, self.start, self.last = bwt[heads], heads, stop - 1
        self.first_sample, self.last_sample = sa[heads], sa[stop - 1]
        # runs by symbol: the rows before each give LF
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        self.offset = np.searchsorted(self.symbol[self.by_symbol], np.arange(len(self.dense) + 2))
        length = (stop - heads)[self.by_symbol]
        lf = np.empty(len(heads), np.int64)
        lf[self.by_symbol] = np.cumsum(length) - length  # C[symbol] + earlier runs of the symbol
        self.shift = lf - heads  # LF of a row is the row plus its run's shift
        self.key = self.symbol[self.by_symbol] * (n + 1) + heads[self.by_symbol]

    @staticmethod
    def symbols(data: np.ndarray, size: np.ndarray, block: np.ndarray) -> np.ndarray:
        return data.astype(np.int64) + 1 + 257 * np.repeat(block, size)

    def query(self, data: np.ndarray, size: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Bytes of other spans in the index's alphabet; -1 for what it lacks."""
        wide = self.symbols(data, size, block)
        return np.where(wide < len(self.dense), self.dense[np.minimum(wide, len(self.dense) - 1)], -1)

    def _codes(self, symbols: int, text: np.ndarray, wide: int) -> np.ndarray:
        """The next symbols of every position packed into a number, ``wide`` bits each, nothing beyond its separator."""
        code = np.zeros(self.n, np.int64)
        text = np.append(text, np.zeros(symbols, np.int64))
        for k in range(symbols):
            code <<= wide
            code |= np.where(self.rest > k, text[k : k + self.n], 0)
        return code

    def _sort(self, text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling.

        A rank is the first row of the suffix's group.  Rank, rank ahead and
        position are packed into one number, so a round is a plain sort, and only
        of the groups that are still tied.
        """
        n, bits = self.n, self.n.bit_length()
        mask = (1 << bits) - 1
        wide = max(1, int(text.max()).bit_length())
        depth = max(1, (63 - bits) // wide)
        packed = np.sort((self._codes(depth, text, wide) << bits) | np.arange(n))
        sa, key = packed & mask, packed >> bits
        new = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            at = sa[tied]
            more = self.rest[at] > depth
            if not more.any():  # equal ranks are final once nothing of their spans is left to compare
                return sa
            ahead = np.where(more, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            if bits <= 20:
                packed = np.sort((((rank[at] << (bits + 1)) | ahead) << bits) | at)
                sa[tied] = packed & mask
                key = packed >> bits
                fresh = np.append(True, key[1:] != key[:-1])
            else:  # a very large slice: the same by three keys
                order = np.lexsort((at, ahead, rank[at]))
                sa[tied] = at[order]
                x, y = rank[at][order], ahead[order]
                fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            new[tied] = fresh
            rank[sa[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
            depth *= 2

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to ``most`` and within their spans."""
        out, live = np.zeros(len(a), np.int64), None
        while len(a):
            same = _PER - np.searchsorted(_LOWEST, self.codes[a] ^ self.codes[b], "right")  # symbols before the highest one that differs
            left = np.minimum(np.minimum(self.rest[a], self.rest[b]) - 1, most)
            go = np.flatnonzero((same == _PER) & (left > _PER))
            if live is None:
                out, live = np.minimum(same, left), go
            else:
                out[live] += np.minimum(same, left)
                live = live[go]
            a, b, most = a[go] + _PER, b[go] + _PER, most[go] - _PER
        return out

    def matching_statistics(self, query: np.ndarray, start: np.ndarray, length: np.ndarray):
        """For ranges of ``query``: yields (step from the right, ranges, match lengths, places of a match in the text)."""
        order = np.argsort(-length, kind="stable")
        row, pos, size = np.zeros(len(order), np.int64), np.full(len(order), self.first_sample[0]), np.zeros(len(order), np.int64)
        longest, last = length[order], (start + length - 1)[order]
        lives = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(order) else 0), "left")
        for step, live in enumerate(lives.tolist()):
            own = order[:live]
            c = query[last[:live] - step]
            q, p, m = row[:live], pos[:live], size[:live]
            run = np.searchsorted(self.start, q, "right") - 1
            fail = np.flatnonzero(self.symbol[run] != c)
            if len(fail):
                lost = fail[c[fail] < 0]  # the symbol is not in the index: start anew
                fail = fail[c[fail] >= 0]
                run[lost], q[lost], p[lost], m[lost] = 0, 0, self.first_sample[0], -1
            if len(fail):
                # nearest runs of the symbol on both sides; the sample with the longer match wins
                cf, mf = c[fail], m[fail]
                at = np.searchsorted(self.key, cf * (self.n + 1) + q[fail])
                has_next, has_prev = at < self.offset[cf + 1], at > self.offset[cf]
                nxt = self.by_symbol[np.minimum(at, len(self.by_symbol) - 1)]
                prv = self.by_symbol[np.maximum(at - 1, 0)]
                # a match of no length needs no comparison
                down, up = np.where(has_next, 0, -1), np.where(has_prev, 0, -1)
                below, above = np.flatnonzero(has_next & (mf > 0)), np.flatnonzero(has_prev & (mf > 0))
                both = np.concatenate([below, above])
                same = self.common(p[fail[both]], np.concatenate([self.first_sample[nxt[below]], self.last_sample[prv[above]]]), mf[both])
                down[below], up[above] = same[: len(below)], same[len(below) :]
                go_up = up > down
                run[fail] = np.where(go_up, prv, nxt)
                q[fail] = np.where(go_up, self.last[prv], self.start[nxt])
                p[fail] = np.where(go_up, self.last_sample[prv], self.first_sample[nxt])
                m[fail] = np.maximum(down, up)
            q += self.shift[run]
            p -= 1
            m += 1
            yield step, own, m, p


def likely(flat: np.ndarray, size: np.ndarray, gram: np.ndarray, window: int) -> np.ndarray:
    """True at window starts whose first and last halves both occur at least twice among the spans of one gram: a filter, not the answer."""
    half = window // 2
    sums = K.byte_sums(flat)
    n = len(flat) - half + 1
    h = K.range_hash(sums, slice(0, n), slice(half, None)) if n > 0 else np.zeros(0, np.uint64)
    tag = K.mix(h + np.repeat(gram, size)[: len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inner = K.inside(np.append(0, np.cumsum(size)), half)
    own = np.flatnonzero(inner)
    _, where, count = np.unique(tag[own], return_inverse=True, return_counts=True)
    again = np.zeros(len(flat) + 1, bool)
    again[own] = count[where] > 1
    start = np.flatnonzero(K.inside(np.append(0, np.cumsum(size)), window))
    return again[start] & again[start + window - half]


def earlier(spans: list[bytes], doc: np.ndarray, gram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hit, first): for each window start of each distinct span, in order, whether a span of the same gram and a smaller ``doc`` has the window; spans begin at ``first``."""
    whole = np.array([len(s) for s in spans], np.int64)
    flat = np.frombuffer(b"".join(spans), np.uint8)
    first = np.concatenate([[0], np.cumsum(whole - window + 1)])
    hit = np.zeros(int(first[-1]), bool)
    # from here on a span is a run of likely windows of one of the given spans
    source, a, b = R.spans_of(likely(flat, whole, gram, window), first)
    if not len(source):
        return hit, first
    begin, size, at = (np.cumsum(whole) - whole)[source] + a, b - a + window - 1, first[source] + a
    doc, gram = doc[source], gram[source]
    order = np.lexsort((doc, gram))
    g, d = gram[order], doc[order]
    other = np.append(True, g[1:] != g[:-1])
    step = np.cumsum(np.append(True, other[1:] | (d[1:] != d[:-1])))
    rank, group = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = step - np.maximum.accumulate(np.where(other, step, 0))
    group[order] = np.cumsum(other) - 1

    def of(own):
        """Bytes of the spans ``own``, one after the other."""
        n = size[own]
        return flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    left = np.cumsum(np.append(0, ~hit))
    for bit in range(int(rank.max()).bit_length()):
        # a span that is hit everywhere is needed no more: what it has, an earlier one has too
        live = left[at + size - window + 1] > left[at]
        later, block = (rank >> bit) & 1 > 0, rank >> (bit + 1)
        pair = group * (int(block.max()) + 1) + block
        both = np.intersect1d(pair[live & ~later], pair[live & later])
        live &= np.isin(pair, both)
        if not live.any():
            continue
        old, new = np.flatnonzero(live & ~later), np.flatnonzero(live & later)
        data, n = of(old)
        index = RunLengthIndex(data, n, block[old])
        data, n = of(new)
        query = index.query(data, n, block[new])
        for back, own, length, place in index.matching_statistics(query, np.cumsum(n) - n, n):
            long = np.flatnonzero(length >= window)
            if len(long):
                span = new[own[long]]
                found = old[np.searchsorted(index.begin, place[long], "right") - 1]
                span = span[doc[found] < doc[span]]
                hit[at[span] + size[span] - 1 - back] = True
        left = np.cumsum(np.append(0, ~hit))
    return hit, first


def earlier_windows(docs: DataFrame, size: int, anchor_gram: int, gram: int) -> DataFrame:
    """(row_key, marks binary of (start, length)): runs of windows that also start in a row with a smaller doc_id."""
    n = buckets(docs)
    hot = R.crowded(docs, "byte", size, gram, n)

    def marks(keys, start, length):
        pairs = np.zeros(len(keys), _MARK)
        pairs["start"], pairs["n"] = start, length
        return R.by_key(keys, pairs, n)

    def send(bucket, group, keys, ids, start, length, texts):
        # equal spans of the flush: the one with the smallest doc_id goes on and covers those with a larger one
        known: dict = {}
        which = np.array([known.setdefault(t, len(known)) for t in texts])
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        covered = ids > least[which]
        if covered.any():
            yield marks(keys[covered], start[covered], length[covered])
        keep = np.flatnonzero(~covered)
        out, a, b = [], [], []
        for x, (own,) in split_by_bucket(bucket[keep], n, keep):
            # one table of (row_key, doc_id) for the blob
            _, firsts, row = np.unique(keys[own], return_index=True, return_inverse=True)
            head = np.zeros(len(own), _HEAD)
            head["row"], head["start"], head["n"], head["gram"] = row, start[own], length[own], group[own]
            out.append(x)
            a.append(R.squeezed(b"".join([texts[i] for i in own.tolist()])))
            b.append(np.array([len(firsts)], "<i8").tobytes() + keys[own][firsts].tobytes() + ids[own][firsts].tobytes() + head.tobytes())
        yield R.moved(out, [0] * len(out), a, b)

    def spans(batches):
        held, texts, count = [], [], 0
        for c in K.chunks(batches, limit=R.CHUNK["byte"]):
            whole = R.Items(c.column("text"), "byte")
            want = R.candidates(whole, c, size, anchor_gram)
            # from here on only the regions that the wanted windows cover
            edge = np.flatnonzero(np.diff(want.astype(np.int8), prepend=0, append=0))
            begin, stop = edge[::2], edge[1::2]
            if not len(begin):
                continue
            span = stop - begin + size - 1
            inner = np.cumsum(span) - span
            items = R.Items(pa.BinaryArray.from_buffers(pa.binary(), len(span), [None, pa.py_buffer(np.append(inner, inner[-1] + span[-1]).astype(np.int32)), pa.py_buffer(whole.raw[np.repeat(begin - inner, span) + np.arange(int(span.sum()))])]), "byte")
            anchor, valid = items.anchors(size, gram)
            own_window = items.windows(size)
            # windows of a crowded gram go singly, by their own hash; runs are at most 255 windows long
            group = np.where(hot[(anchor % np.uint64(len(hot))).astype(np.int64)], own_window, anchor)
            at, length = R.runs(group, valid, items.first)
            at, length, g, _ = R.pieces(at, length, group[at], np.zeros(len(at), bool))
            data = items.raw.tobytes()
            texts += [data[x : x + y] for x, y in zip(at.tolist(), (length + size - 1).tolist(), strict=True)]
            keys, ids = (c.column(x).to_numpy(zero_copy_only=False) for x in ("row_key", "doc_id"))
            region = K.owner(items.first, at)
            source = begin[region] + at - inner[region]
            row = K.owner(whole.first, source)
            held.append((((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64), (g & np.uint64(2**32 - 1)).astype(np.int64), keys[row], ids[row], source - whole.first[row], length))
            count += len(at)
            if count >= R.FLUSH // 4:
                yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)), texts)
                held, texts, count = [], [], 0
        if count:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)), texts)

    def index(batches):
        heads, keys, ids, blobs = [], [], [], []
        for batch in batches:
            yield batch.filter(batch.column("b").is_null())  # answers on their way
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if b is None:
                    continue
                m = int(np.frombuffer(b, "<i8", 1)[0])
                head = np.frombuffer(b, _HEAD, -1, 8 + 16 * m)
                keys.append(np.frombuffer(b, "<i8", m, 8)[head["row"]])
                ids.append(np.frombuffer(b, "<i8", m, 8 + 8 * m)[head["row"]])
                heads.append(head)
                blobs.append(R.opened(a))
        if not heads:
            return
        head, keys, ids = np.concatenate(heads), np.concatenate(keys), np.concatenate(ids)
        bounds = np.concatenate([[0], np.cumsum(head["n"].astype(np.int64) + size - 1)]).tolist()
        data = b"".join(blobs)
        del blobs, heads
        known: dict = {}
        which = np.array([known.setdefault(data[x:y], len(known)) for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
        del data
        texts = list(known)
        del known
        least, gram = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
        np.minimum.at(least, which, ids)
        gram[which] = head["gram"]
        # slices of whole grams; a gram with one document has nothing to match
        order = np.lexsort((least, gram))
        edges = R.cut(gram[order])
        count = np.array([len(t) for t in texts], np.int64) - size + 1
        volume = np.append(0, np.cumsum(count[order] + size - 1))
        many = least[order[edges[:-1]]] < least[order[edges[1:] - 1]]
        hits: list = [None] * len(texts)
        x = 0
        while x < len(many):
            y = max(x + 1, int(np.searchsorted(volume[edges], volume[edges[x]] + SLICE, "right")) - 1)
            own = order[edges[x] : edges[y]][np.repeat(many[x:y], np.diff(edges[x : y + 1]))]
            x = y
            if len(own):
                hit, first = earlier([texts[i] for i in own.tolist()], least[own], gram[own], size)
                for i, a, b in zip(own.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if hit[a:b].any():
                        hits[i] = hit[a:b]
        # a copy of a span in a larger doc_id is repeated whole
        copy = ids > least[which]
        part = np.flatnonzero(~copy & np.array([h is not None for h in hits], bool)[which])
        if len(part):
            n_own = count[which[part]]
            span, a, b = R.spans_of(np.concatenate([hits[i] for i in which[part].tolist()]), np.append(0, np.cumsum(n_own)))
            yield marks(keys[part][span], head["start"][part][span] + a, b - a)
        yield marks(keys[copy], head["start"][copy], head["n"][copy])

    likely = R.join_rows(docs, R.repeated_anchors(docs, "byte", size, anchor_gram, across=True), "inner")
    sent = likely.mapInArrow(spans, R.MOVED)
    return R.gathered(sent.repartitionById(n, F.col("bucket")).mapInArrow(index, R.MOVED), "marks", 8, n)


def dedup(documents: DataFrame, size: int = 50, anchor_gram: int = 20, gram: int = 10) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes long, spans array<struct<start, end>>, kept binary.

    ``spans`` are the maximal runs of bytes of the text (UTF-8; null: empty) that
    are covered by strings of ``size`` bytes which also start in a document with a
    smaller doc_id; ``kept`` has the other bytes.  Rows that share a doc_id do not
    count for each other.  A null doc_id is larger than all others, so such a row
    loses what any document with an id has, and nothing for other null rows.
    Texts shorter than ``size`` lose nothing.  An empty table gives no rows; other
    columns are not read.
    """
    docs = keyed(documents).select("row_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 2)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")

    def finish(batches):
        for c in K.chunks(batches):
            offs, raw = K.offsets_of(c.column("text"))
            n = c.num_rows
            own = [np.frombuffer(x or b"", "<u4").reshape(-1, 2).astype(np.int64) for x in c.column("marks").to_pylist()]
            every = np.concatenate(own) if own else np.zeros((0, 2), np.int64)
            gone = R.cover(len(raw), every[:, 0] + np.repeat(offs[:-1], [len(x) for x in own]), every[:, 1] + size - 1)
            left = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(left), pa.py_buffer(raw[~gone])])
            ids = pa.array(c.column("doc_id").to_numpy(zero_copy_only=False), mask=c.column("no_id").to_numpy(zero_copy_only=False))
            yield pa.record_batch([ids, pa.array(np.diff(offs)), R.span_array(*R.spans_of(gone, offs), n), kept], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = R.join_rows(docs, earlier_windows(docs, size, anchor_gram, gram), "left")
    return rows.select("doc_id", "no_id", "text", "marks").mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
