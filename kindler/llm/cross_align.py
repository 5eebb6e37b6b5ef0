"""Alignment of two tokenizers over the same bytes, and statistics of their links.

A batch's documents are one run of bytes (a space before each text).  The ends of
both tokenizers' tokens are counted once over that run; where both count, the
text is cut: between two cuts lies a group, and the two tokens that end at a cut
are linked.  Prefix sums over cuts, read at the documents' borders, give each
document's figures.

Links are counted over the corpus by pair of ids.  A block of documents holds each
distinct pair once, with its number; counts are summed by pair, and each block asks
for the pairs it has.  Nothing is broadcast and no row holds more than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import written
from .piece_encoding import SPACE, Model, PieceEncoder, lists
from .units import ByteLevelEncoder, pooled, ranges

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 1 << 18
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, a array<int>, b array<int>, n array<long>, links binary"
ALIGNED = "row_key long, doc_id long, a_ids array<int>, b_ids array<int>, cuts array<int>"


class Alignment:
    """Tokens and cuts of a batch; documents whose tokens are not exactly their bytes have none."""

    def __init__(self, a_path: str, b_path: str):
        self.a_encoder, self.b_encoder = ByteLevelEncoder(a_path), PieceEncoder(Model(b_path))
        self.a_pool = pooled(self.a_encoder.bytes)
        self.b_pool = pooled([x.replace(SPACE, b" ") for x in self.b_encoder.model.normal])
        self.digits = pooled([b"?%d" % i for i in range(max(len(self.a_encoder.bytes), len(self.b_encoder.model.pieces)))])

    @staticmethod
    def _same(pool, ids, first, bounds, raw):
        """Documents whose tokens' bytes are theirs."""
        size = pool[2][ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        made = ranges(pool[0], pool[1][ids], size)
        good = np.diff(ends[first]) == np.diff(bounds)
        if good.all() and np.array_equal(made, raw):
            return good
        here = ranges(raw, bounds[:-1][good], np.diff(bounds)[good])
        there = ranges(made, ends[first[:-1]][good], np.diff(bounds)[good])
        wrong = np.concatenate([[0], np.cumsum(here != there)])
        at = np.concatenate([[0], np.cumsum(np.diff(bounds)[good])])
        good[good] = np.diff(wrong[at]) == 0
        return good

    def __call__(self, offs: np.ndarray, raw: np.ndarray):
        full = np.diff(offs) > 0
        spaced = np.insert(raw, offs[:-1][full], 0x20)
        bounds = offs + np.concatenate([[0], np.cumsum(full)])
        a, a_first = self.a_encoder.encode(bounds, spaced)
        b, b_first, _, _ = self.b_encoder.encode(offs, raw)
        good = full & self._same(self.a_pool, a, a_first, bounds, spaced) & self._same(self.b_pool, b, b_first, bounds, spaced)
        # only the tokens and bytes of good documents are left
        size = np.where(good, np.diff(bounds), 0)
        a, self.a_first = self._kept(a, a_first, good)
        b, self.b_first = self._kept(b, b_first, good)
        self.a, self.b, self.bounds = a, b, np.concatenate([[0], np.cumsum(size)])
        total = int(self.bounds[-1])
        a_ends, b_ends = np.cumsum(self.a_pool[2][a]), np.cumsum(self.b_pool[2][b])
        both = (np.bincount(a_ends, minlength=total + 1) + np.bincount(b_ends, minlength=total + 1)) == 2
        both[0] = False
        self.cuts = np.flatnonzero(both)
        self.cuts_until = np.cumsum(both)  # cuts at or before a byte
        a_cut, b_cut = both[a_ends], both[b_ends]
        self.a_group, self.b_group = self.cuts_until[a_ends] - a_cut, self.cuts_until[b_ends] - b_cut
        self.link_a, self.link_b = a[a_cut], b[b_cut]
        self.link_first = self.cuts_until[self.bounds]
        return self

    @staticmethod
    def _kept(ids, first, good):
        n = np.where(good, np.diff(first), 0)
        return ranges(ids, first[:-1], n), np.concatenate([[0], np.cumsum(n)])

    def group_digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document; empty for those without tokens."""
        a_at = np.arange(len(self.a)) + np.searchsorted(self.b_group, self.a_group, "left")
        b_at = np.arange(len(self.b)) + np.searchsorted(self.a_group, self.b_group, "right")
        ids, sign = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        sign[a_at[np.append(True, self.a_group[1:] != self.a_group[:-1])[: len(a_at)]]] = ord(";")
        sign[b_at[np.append(True, self.b_group[1:] != self.b_group[:-1])[: len(b_at)]]] = ord("|")
        size = self.digits[2][ids]
        text = ranges(self.digits[0], self.digits[1][ids], size).copy()
        begin = np.concatenate([[0], np.cumsum(size)])
        text[begin[:-1]] = sign
        data, edge = text.tobytes(), begin[self.a_first + self.b_first].tolist()
        return [hashlib.sha256(data[x + 1 : y]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:], strict=True)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row_key, doc_id, a_ids, b_ids, cuts of every row of ``docs``.

    The texts are encoded without special tokens, with a space in front.  ``cuts``
    are the byte offsets, counted from that space, where tokens of both end.  Null
    and empty texts, and those whose tokens of either kind do not add up to their
    bytes, have no tokens.  Rows that repeat an id stay separate rows; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches):
        made = Alignment(a_path, b_path)
        for c in K.chunks(batches, limit=BLOCK):
            x = made(*K.offsets_of(c.column("text")))
            doc = np.searchsorted(x.bounds, x.cuts, "left") - 1
            yield pa.record_batch([c.column("row_key"), c.column("doc_id"), lists(x.a, x.a_first), lists(x.b, x.b_first), lists(x.cuts - x.bounds[doc], x.link_first)], names=["row_key", "doc_id", "a_ids", "b_ids", "cuts"])

    return _rows(docs).mapInArrow(run, ALIGNED)


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of documents: their figures, the block's distinct links and how often it has them, and the link numbers of each document."""

    def run(batches):
        made, number = Alignment(a_path, b_path), TaskContext.get().partitionId() << 32
        for c in K.chunks(batches, limit=BLOCK):
            x = made(*K.offsets_of(c.column("text")))
            pair, index, n = np.unique((x.link_a.astype(np.int64) << 32) | x.link_b, return_inverse=True, return_counts=True)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
            long, integer = pa.int64(), pa.int32()
            columns = [pa.array([number], long), one(c.column("doc_id"), long), *(one(np.diff(v), long) for v in (x.a_first, x.b_first, x.link_first)), one(x.group_digests(), pa.string())]
            columns += [one((pair >> 32).astype(np.int32), integer), one((pair & 0xFFFFFFFF).astype(np.int32), integer), one(n, long), pa.array([index.astype("<u4").tobytes()], pa.binary())]
            yield pa.record_batch(columns, names=[f.split()[0] for f in BLOCKS.split(", ")])
            number += 1
        del made
        K.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best) of every linked pair of ids: its links over all ``blocks``, and whether no pair of the same b has more."""
    total = asked(made).groupBy("a", "b").agg(F.sum("n").alias("count"))
    total = written(total)
    most = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def asked(made: DataFrame) -> DataFrame:
    """(block, at, a, b, n): the distinct links of each block, numbered."""
    return made.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("block", "at", "p.a", "p.b", "p.n")


def link_figures(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair has the most links of its b id over the
    whole corpus, ties included; ``count_sum`` adds up the pairs' counts over the
    links.  Documents without tokens (see ``align``) have zeros and an empty
    digest.  Repeated rows count as often as they occur.
    """
    made = written(blocks(docs, a_path, b_path))
    found = asked(made).join(pair_counts(made), ["a", "b"])
    answers = found.groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                doc_id, n_a, n_b, n_groups, digest = (c[i].values for c in columns[:5])
                link = np.frombuffer(columns[5][i].as_py(), "<u4")
                count, best = np.zeros(int(link.max()) + 1 if len(link) else 0, np.int64), np.zeros(int(link.max()) + 1 if len(link) else 0, bool)
                if len(link):
                    answer = columns[6][i].values
                    at = answer.field("at").to_numpy()
                    count[at], best[at] = answer.field("count").to_numpy(), answer.field("best").to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(n_groups.to_numpy())])
                segment = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(v[link], dtype=np.int64)])[first]))
                yield pa.record_batch([doc_id, n_a, n_b, n_groups, n_groups, segment(best), segment(count), digest], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = made.join(answers, "block", "left").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "found")
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
