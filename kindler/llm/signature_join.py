"""N-gram Jaccard join with signature trees.

Texts become sets of word-shingle hashes; equal sets are one node.  Two sets
that link share a token among the first few of any fixed order of tokens (the
prefix filter), here rarest first by a sketch of fixed size.  Prefix tokens join
sets into blocks: every link lies inside a block.  In a block a signature tree
(nodes with OR- and AND-combined token bitmaps and size ranges) is traversed
against itself; node pairs that cannot reach the overlap are pruned, and so are
pairs already connected; the pairs that remain are verified on the whole sets.

A large block is cut into chunks of bounded size.  Chunks are joined with a few
pivots of the block first; then only the sets outside the block's largest
component meet all chunks, so near copies by the thousand do not become pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import repeats as R
from . import textkernel as K
from .common import components, keyed, partitions, split_by_bucket, written

U = np.uint64
_SLICES = 16
#: Larger groups of sets that share a prefix token are chained instead of paired.
PAIRED = 128
_BITS = 512
#: Tokens in a task of the tree join, and pivots of a block that has more.
CHUNK_TOKENS, PIVOTS = 1_500_000, 24
_T48 = U(2**48 - 1)


def shingle_sets(offs: np.ndarray, raw: np.ndarray, size: int):
    """(48-bit tokens, bounds): the sorted set of each row; rows of fewer words have their whole sequence as one shingle."""
    start, end, first = K.words_of(offs, raw)
    h = K.range_hash(K.byte_sums(raw, folded=True), start, end)
    rows = len(offs) - 1
    own = K.windows_hash(h, size)
    at = np.flatnonzero(K.inside(first, size))
    row, token = K.owner(first, at), own[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([int(K.windows_hash(h[first[i] : first[i + 1]], int(count[i]))[0]) ^ (int(count[i]) << 40) for i in short], np.uint64)
        row, token = np.concatenate([row, short]), np.concatenate([token, extra])
    both = np.sort((row.astype(np.uint64) << U(48)) | (K.mix(token) & _T48))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return both & _T48, np.searchsorted(both >> U(48), np.arange(rows + 1, dtype=np.uint64))


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A signed 64-bit id of each set; 0 for the empty one."""
    sums = np.concatenate([[U(0)], np.cumsum(K.mix(tokens + U(0x51ED27)), dtype=np.uint64)])
    n = np.diff(bounds)
    out = K.mix((sums[bounds[1:]] - sums[bounds[:-1]]) + n.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)
    return np.where(n == 0, 0, np.where(out == 0, 1, out))


def signature_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, at least twice its size up to 65536."""
    return 2 ** np.clip(np.ceil(np.log2(np.maximum(2 * n, 64))), 6, 16).astype(np.int64)


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of each set: bit token mod bits."""
    n = np.diff(bounds)
    bits = signature_bits(n)
    begin = np.cumsum(bits) - bits
    field = np.zeros(int(bits.sum()), bool)
    field[np.repeat(begin, n) + (tokens.astype(np.int64) & (np.repeat(bits, n) - 1))] = True
    packed = np.packbits(field).tobytes()
    return [packed[i // 8 : (i + w) // 8] for i, w in zip(begin.tolist(), bits.tolist(), strict=True)]


def folded(bitmaps: bytes, width: int, bits: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes each with fewer bits: the OR of their parts, a row for each."""
    return np.bitwise_or.reduce(np.frombuffer(bitmaps, np.uint8).reshape(-1, 8 * width // bits, bits // 8), axis=1)


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """row_key, doc_id, n, set_id, signature of every row of ``docs``."""

    def run(batches):
        for c in K.chunks(batches, limit=R.CHUNK["word"]):
            tokens, bounds = shingle_sets(*K.offsets_of(c.column("text")), size)
            yield pa.record_batch([c.column("row_key"), c.column("doc_id"), pa.array(np.diff(bounds)), pa.array(set_ids(tokens, bounds)), pa.array(signatures(tokens, bounds), pa.binary())], names=["row_key", "doc_id", "n", "set_id", "signature"])

    return docs.mapInArrow(run, "row_key long, doc_id long, n long, set_id long, signature binary")


def token_levels(docs: DataFrame, size: int, rows: int) -> np.ndarray:
    """log2 of how far the count of a token's cell is above the mean: a table of a few bytes for each document, 16 MB at most."""
    cells = 1 << min(24, max(18, rows.bit_length() + 3))

    def count(batches):
        total = np.zeros(cells, np.int32)
        for c in K.chunks(batches, limit=R.CHUNK["word"]):
            np.add.at(total, (shingle_sets(*K.offsets_of(c.column("text")), size)[0] % U(cells)).astype(np.int64), 1)
        yield R.moved(range(_SLICES), [0] * _SLICES, [R.squeezed(x.astype("<i4").tobytes()) for x in np.split(total, _SLICES)], [None] * _SLICES)

    def add(batches):
        total: dict = {}
        for b in batches:
            for i, a in zip(b.column("bucket").to_pylist(), b.column("a").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(R.opened(a), "<i4").astype("<i8")
        yield R.moved(list(total), [0] * len(total), [x.tobytes() for x in total.values()], [None] * len(total))

    out = np.zeros((_SLICES, cells // _SLICES), np.int64)
    for r in docs.select("text").mapInArrow(count, R.MOVED).repartitionById(_SLICES, F.col("bucket")).mapInArrow(add, R.MOVED).collect():
        out[r["bucket"]] = np.frombuffer(r["a"], "<i8")
    out = out.ravel()
    return np.clip(np.floor(np.log2(np.maximum(out, 1) / max(1.0, out.mean()))), 0, 15).astype(np.uint8)


def local_components(a: np.ndarray, b: np.ndarray):
    """(nodes, least node of each one's component)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def may_link(small, large, percent: int):
    return 100 * small >= percent * large


def candidate_pairs(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(a, b, sure) of set ids: every link is among the pairs, or inside a component of the sure ones."""
    n = partitions(docs.sparkSession)

    def send(held):
        ids, sizes, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        tokens = np.concatenate([x[3] for x in held])
        begin = np.cumsum(counts) - counts
        _, keep = np.unique(ids, return_index=True)  # equal sets of the flush are sent once
        keep = keep[counts[keep] > 0]
        own = np.repeat(keep, counts[keep])
        at = np.repeat(begin[keep] - (np.cumsum(counts[keep]) - counts[keep]), counts[keep]) + np.arange(int(counts[keep].sum()))
        g = R.compact(tokens[at], n)
        buckets, a, b = [], [], []
        for bucket, (x, who) in split_by_bucket((g >> U(32)).astype(np.int64), n, g & R._LOW, own):
            table, index = R.pack_keys(who)
            buckets.append(bucket)
            a.append(x.astype("<u4").tobytes())
            b.append(np.array([len(table), index.itemsize], "<i8").tobytes() + ids[table].tobytes() + index.tobytes() + sizes[table].astype("<i8").tobytes())
        yield R.moved(buckets, [0] * len(buckets), a, b)

    def prefixes(batches):
        held, count = [], 0
        for c in K.chunks(batches, limit=R.CHUNK["word"]):
            tokens, bounds = shingle_sets(*K.offsets_of(c.column("text")), size)
            sizes = np.diff(bounds)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ranked = np.sort((row.astype(np.uint64) << U(48)) | (levels[(tokens % U(len(levels))).astype(np.int64)].astype(np.uint64) << U(44)) | (tokens >> U(4)))
            take = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
            first = np.arange(len(ranked)) - np.repeat(bounds[:-1], sizes) < np.repeat(take, sizes)
            held.append((set_ids(tokens, bounds), sizes, take, K.mix(ranked[first] & U(2**44 - 1))))
            count += int(take.sum())
            if count >= R.FLUSH:
                yield from send(held)
                held, count = [], 0
        if count:
            yield from send(held)

    def meet(batches):
        low, ids, sizes = [], [], []
        for batch in batches:
            for bucket, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                m, width = (int(x) for x in np.frombuffer(b, "<i8", 2))
                count = len(a) // 4
                index = np.frombuffer(b, np.uint16 if width == 2 else np.uint32, count, 16 + 8 * m)
                low.append(np.frombuffer(a, "<u4"))
                ids.append(np.frombuffer(b, "<i8", m, 16)[index])
                sizes.append(np.frombuffer(b[16 + 8 * m + width * count :], "<i8", m)[index])
        if not low:
            return
        low, ids, sizes = np.concatenate(low), np.concatenate(ids), np.concatenate(sizes)
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        if not len(order):  # no two sets of the bucket meet
            return
        low, ids, sizes = low[order], ids[order], sizes[order]
        order = np.lexsort((ids, sizes, low))
        low, ids, sizes = low[order], ids[order], sizes[order]
        fresh = np.append(True, (low[1:] != low[:-1]) | (ids[1:] != ids[:-1]))
        low, ids, sizes = low[fresh], ids[fresh], sizes[fresh]
        edges = R.cut(low)
        group = np.repeat(np.diff(edges), np.diff(edges))
        # large groups: neighbours in size order; where two are too far apart in size, nothing links across
        near = (low[1:] == low[:-1]) & (group[1:] > PAIRED) & may_link(sizes[:-1], sizes[1:], percent)
        nodes, root = local_components(ids[:-1][near], ids[1:][near])
        nodes, root = nodes[nodes != root], root[nodes != root]
        yield pa.record_batch([pa.array(nodes), pa.array(root), pa.array(np.ones(len(nodes), bool))], names=["a", "b", "sure"])
        # others: all pairs that sizes allow, each once
        few = group <= PAIRED
        low, ids, sizes = low[few], ids[few], sizes[few]
        pairs = np.zeros((0, 2), np.int64)
        for step in range(1, PAIRED):
            if step >= len(low):
                break
            ok = (low[step:] == low[:-step]) & may_link(sizes[:-step], sizes[step:], percent)
            if not (low[step:] == low[:-step]).any():
                break
            x, y = ids[:-step][ok], ids[step:][ok]
            pairs = np.concatenate([pairs, np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)])
            if len(pairs) > 2_000_000:
                pairs = np.unique(pairs, axis=0)
        pairs = np.unique(pairs, axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(pairs), bool))], names=["a", "b", "sure"])

    sent = docs.select("text").mapInArrow(prefixes, R.MOVED).repartitionById(n, F.col("bucket"))
    return sent.mapInArrow(meet, "a long, b long, sure boolean")


def room_left(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, sa, sb, na, nb) whose bitmaps allow the overlap."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            keep = np.zeros(len(a), bool)
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            widths = np.array([len(x) for x in sa]) << 20 | np.array([len(y) for y in sb])
            for w in np.unique(widths).tolist():
                own = np.flatnonzero(widths == w)
                bits = 8 * min(w >> 20, w & 0xFFFFF)
                x, y = (folded(b"".join([side[i] for i in own.tolist()]), size, bits) for side, size in ((sa, w >> 20), (sb, w & 0xFFFFF)))
                missing_x, missing_y = (np.bitwise_count(d).sum(axis=1, dtype=np.int64) for d in (x & ~y, y & ~x))
                overlap = np.minimum(na[own] - missing_x, nb[own] - missing_y)
                keep[own] = overlap * (100 + percent) >= percent * (na[own] + nb[own])
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


class SignatureTree:
    """Sets in leaves; every node has OR and AND bitmaps of its sets' tokens, a size range, and its one label if it has only one."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, label: np.ndarray, fan: int = 8):
        n = len(bounds) - 1
        bits = np.zeros((n, _BITS), bool)
        bits[np.repeat(np.arange(n), np.diff(bounds)), (tokens % U(_BITS)).astype(np.int64)] = True
        leaf = np.packbits(bits, axis=1).view(np.uint64)
        size = np.diff(bounds)
        self.any, self.all, self.least, self.most, self.low, self.high = [leaf], [leaf], [size], [size], [label], [label]
        self.fan = fan
        while len(self.any[-1]) > 1:
            at = np.arange(0, len(self.any[-1]), fan)
            for levels, f in ((self.any, np.bitwise_or), (self.all, np.bitwise_and), (self.least, np.minimum), (self.most, np.maximum), (self.low, np.minimum), (self.high, np.maximum)):
                levels.append(f.reduceat(levels[-1], at, axis=0))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs that may hold a link between different labels: by labels, sizes and the largest possible overlap."""
        any_, all_, least, most = self.any[level], self.all[level], self.least[level], self.most[level]
        open_ = ~((self.low[level][a] == self.high[level][a]) & (self.low[level][b] == self.high[level][b]) & (self.low[level][a] == self.low[level][b]))
        open_ &= may_link(most[a], least[b], percent) & may_link(most[b], least[a], percent)
        live = np.flatnonzero(open_)
        x, y = a[live], b[live]
        missing_x = np.bitwise_count(all_[x] & ~any_[y]).sum(axis=1, dtype=np.int64)
        missing_y = np.bitwise_count(all_[y] & ~any_[x]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(most[x] - missing_x, most[y] - missing_y)
        # overlap >= percent% of the union means overlap * (100 + percent) >= percent * (sizes added up)
        open_[live] = overlap * (100 + percent) >= percent * (least[x] + least[y])
        return open_

    def candidate_pairs(self, percent: int, block: int = 100_000):
        """Pairs of leaves (a < b) that survive the traversal of the tree against itself."""
        stack = [(len(self.any) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            keep = self.possible(level, a, b, percent) if level else self.possible(0, a, b, percent) & (a < b)
            a, b = a[keep], b[keep]
            if not level or not len(a):
                if len(a):
                    yield a, b
                continue
            n, f = len(self.any[level - 1]), self.fan
            step = max(1, block // (f * f))
            for i in range(0, len(a), step):
                x = (a[i : i + step, None] * f + np.arange(f))[:, :, None]
                y = (b[i : i + step, None] * f + np.arange(f))[:, None, :]
                x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
                ok = (x < n) & (y < n) & (x <= y)
                stack.append((level - 1, x[ok], y[ok]))


def tree_links(ids: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, percent: int, label: np.ndarray | None = None):
    """Links (a, b) that connect ids exactly as all links do; ids of one ``label`` count as connected."""
    n = len(ids)
    _, label = np.unique(ids if label is None else label, return_inverse=True)
    label = label.astype(np.int64).copy()
    size = np.diff(bounds)
    a_out, b_out = [], []

    def unite(x: int, many: np.ndarray):
        for l in np.unique(label[many]):
            if l != label[x]:
                y = int(many[label[many] == l][0])
                a_out.append(ids[x])
                b_out.append(ids[y])
                label[label == l] = label[x]

    def overlaps(x: int, rows: np.ndarray) -> np.ndarray:
        own = tokens[bounds[x] : bounds[x + 1]]
        counts = size[rows]
        at = np.repeat(bounds[rows] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        t = tokens[at]
        hit = own[np.minimum(np.searchsorted(own, t), len(own) - 1)] == t
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(counts) - counts)

    # stars around a few members settle groups of near copies before the traversal
    tried = np.zeros(n, bool)
    for _ in range(16 if n > 8 else 1):
        if (label == label[0]).all() or tried.all():
            break
        count = np.bincount(label)
        x = int(np.flatnonzero(~tried)[np.argmin(count[label[~tried]])])  # from the smallest component
        tried[x] = True
        rows = np.flatnonzero((label != label[x]) & may_link(np.minimum(size, size[x]), np.maximum(size, size[x]), percent))
        if len(rows):
            shared = overlaps(x, rows)
            unite(x, rows[100 * shared >= percent * (size[rows] + size[x] - shared)])
    if (label == label[0]).all():
        return np.array(a_out, np.int64), np.array(b_out, np.int64)
    order = np.lexsort((size, label))
    counts = size[order]
    moved = np.concatenate([[0], np.cumsum(counts)])
    flat = tokens[np.repeat(bounds[:-1][order] - moved[:-1], counts) + np.arange(int(moved[-1]))]
    tree = SignatureTree(flat, moved, label[order])
    for a, b in tree.candidate_pairs(percent):
        # verified one left set at a time, against all its partners that are not connected yet
        left, right = order[a], order[b]
        by = np.argsort(left, kind="stable")
        left, right = left[by], right[by]
        edges = R.cut(left)
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            x, rows = int(left[i]), right[i:j]
            rows = rows[label[rows] != label[x]]
            if len(rows):
                shared = overlaps(x, rows)
                unite(x, rows[100 * shared >= percent * (size[rows] + size[x] - shared)])
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def join_groups(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) within each group of ``rows`` (group columns g1, g2, g3, then set_id, label, text), one group at a time."""

    def run(batches):
        held: list = []

        def close():
            _, keep = np.unique(np.array([r[0] for r in held], np.int64), return_index=True)
            tokens, bounds = shingle_sets(*K.offsets_of(pa.array([held[i][2] for i in keep], pa.large_string())), size)
            a, b = tree_links(np.array([held[i][0] for i in keep], np.int64), tokens, bounds, percent, np.array([held[i][1] for i in keep], np.int64))
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        now = None
        for batch in batches:
            for *group, set_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "g3", "set_id", "label", "text")), strict=True):
                if group != now and held:
                    yield close()
                    held = []
                now = group
                held.append((set_id, label, text))
        if held:
            yield close()

    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return dealt.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of set ids: verified links that connect sets exactly as all links do."""
    one = written(sets.where("n > 0").groupBy("set_id").agg(F.min(F.struct("row_key", "n", "signature")).alias("s")).select("set_id", "s.*"))
    pairs = written(candidate_pairs(docs, size, percent, token_levels(docs, size, one.count())))
    side = lambda x: one.select(F.col("set_id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    checked = room_left(pairs.where("not sure").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), percent)
    block = components(checked.unionByName(pairs.where("sure").select("a", "b"))).select(F.col("node").alias("set_id"), F.col("component").alias("block"))
    members = written(one.select("set_id", "row_key", "n").join(block, "set_id"))
    whole = members.groupBy("block").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).cast("int").alias("chunks"))
    chosen = members.join(whole, "block").withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks").cast("int"))
    full = written(docs.select("row_key", "text").join(chosen.hint("shuffle_hash"), "row_key").select("block", "chunks", "chunk", "set_id", "n", "text"))
    # pivots of large blocks go to all their chunks
    large = full.where("chunks > 1")
    pivots = large.withColumn("r", F.row_number().over(Window.partitionBy("block", "chunk").orderBy(F.xxhash64("set_id", F.lit(1))))).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.lit(PIVOTS) / F.col("chunks"))))
    pivots = pivots.where(F.col("chunk") < PIVOTS).select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "set_id", "text")
    group = lambda df: df.select(F.col("block").alias("g1"), F.col("chunk").alias("g2"), F.lit(0).alias("g3"), "set_id", F.col("set_id").alias("label"), "text")
    found = written(join_groups(group(full).unionByName(group(pivots)), size, percent))
    if large.limit(1).count():
        label = components(found.unionByName(large.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))))
        labels = written(large.select("block", "chunks", "chunk", "set_id", "n").join(label.select(F.col("node").alias("set_id"), F.col("component").alias("label")), "set_id"))
        count = labels.groupBy("block", "label").agg(F.count("*").alias("c"))
        main = count.groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        rest = labels.join(main, "block").where("label <> main")
        parts = rest.groupBy("block").agg(F.ceil(F.sum("n") / CHUNK_TOKENS).cast("int").alias("parts"))
        rest = rest.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("g2"), F.pmod(F.xxhash64("set_id", F.lit(2)), "parts").cast("int").alias("g3"), "set_id", "label")
        every = labels.join(parts, "block").select("block", F.col("chunk").alias("g2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g3"), "set_id", "label")
        again = rest.unionByName(every).withColumnRenamed("block", "g1").join(large.select("set_id", "text"), "set_id")
        found = found.unionByName(join_groups(again, size, percent))
    return found


def labelled(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the set of every row, label of every linked set)."""
    docs = keyed(documents).select("row_key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(sets_of(docs, size))
    return sets, components(links(docs, sets, size, percent)).select(F.col("node").alias("set_id"), F.col("component").alias("label"))


def representatives(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """row_key of one row of each group of linked texts (the smallest doc_id, then the smallest row_key; null ids last), and of the rows without words."""
    sets, label = labelled(documents, size, percent)
    of = sets.where("n > 0").join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    first = of.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    return first.select("first.row_key").unionByName(sets.where("n = 0").select("row_key").distinct())


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents``: doc_id long, n_shingles long, component_id long.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set
    has its distinct ``size``-word shingles, or its whole sequence if it has fewer
    words.  Two documents link when their sets' intersection is at least
    ``percent`` of the union; component_id is the smallest doc_id that links
    reach.  Null texts and texts without words have no shingles and link with
    nothing.  Rows that repeat a doc_id are separate rows whose links count for
    that id's component alike; a row with a null doc_id takes part in links, and
    its component is null only if no document with an id is reached.  An empty
    table gives no rows; other columns are not read.
    """
    sets, label = labelled(documents, size, percent)
    # nodes are sets; a doc_id with several sets connects them
    many = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a <> b")
    tied = sets.where("n > 0").join(many, "doc_id").select(F.col("set_id").alias("a"), "b")
    if tied.limit(1).count():
        label = components(label.select(F.col("set_id").alias("a"), F.col("label").alias("b")).unionByName(tied)).select(F.col("node").alias("set_id"), F.col("component").alias("label"))
    of_set = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("low")).join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = of_set.groupBy("label").agg(F.min("low").alias("component_id"))
    named = of_set.select("set_id", "label").join(least, "label").select("set_id", "component_id")
    rows = sets.join(named, "set_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
