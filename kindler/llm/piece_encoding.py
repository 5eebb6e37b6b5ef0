"""SentencePiece encoding that keeps the place of every piece in the text, and decoding.

A text is normalised by the model's own rules: at every place the longest prefix
found in the compiled character map (a double-array trie) is replaced, other
characters are copied, white space is reduced and escaped as the model asks.  Each
normalised byte remembers the byte of the text it comes from.  The normalised text
is cut into units that no piece crosses, each distinct unit is segmented once, and
every piece is projected back to a byte span of the original text.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .units import UnitCache, ends_with, pooled, ranges

SPACE = "▁".encode()
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ENCODED = "row_key long, doc_id long, ids array<int>, begins array<int>, ends array<int>"


def fields(data: bytes):
    """(number, value) of a serialised message: integers, or bytes of strings, messages and fixed-width numbers."""
    at = 0

    def integer():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = integer()
        if key & 7 == 0:
            yield key >> 3, integer()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = integer() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """What a model file says: pieces and their kinds, the compiled character map, the rules of white space."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        self.data = data
        top = list(fields(data))
        entries = [dict(fields(v)) for k, v in top if k == 1]
        self.pieces = [e.get(1, b"") for e in entries]
        self.kinds = np.array([e.get(3, NORMAL) for e in entries])
        trainer: dict = {}
        rules: dict = {}
        for k, v in top:
            if k == 2:
                trainer.update(fields(v))
            if k == 3:
                rules.update(fields(v))
        self.unknown = trainer.get(44, " ⁇ ".encode())
        if trainer.get(24, 0) or not trainer.get(35, 0):
            raise ValueError("only models with byte fallback and white space as a prefix are supported")
        self.char_map, self.dummy_prefix, self.reduce, self.escape = rules.get(2, b""), rules.get(3, 1), rules.get(4, 1), rules.get(5, 1)
        byte = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        #: Bytes of each piece in the normalised text.
        self.normal = [bytes([byte[i]]) if i in byte else b"" if k in (CONTROL, UNKNOWN) else p for i, (p, k) in enumerate(zip(self.pieces, self.kinds.tolist(), strict=True))]
        # units may end before white space unless a piece holds white space after another character, or is taken out of the text whole
        plain = [p.decode() for p, k in zip(self.pieces, self.kinds.tolist(), strict=True) if k == NORMAL]
        self.cuttable = bool(self.escape) and not (self.kinds == USER_DEFINED).any() and not any("▁" in p.lstrip("▁") for p in plain)

    def segmenter(self):
        """The library's segmentation of text that is normalised already."""
        import sentencepiece

        # a later field of a message overrides an earlier one: no character map, no changes of white space
        own = b"\x0a\x08identity" + b"\x12\x00" + b"\x18\x00\x20\x00\x28\x00"
        processor = sentencepiece.SentencePieceProcessor(model_proto=self.data + b"\x1a" + bytes([len(own)]) + own)
        return lambda text: np.array(processor.encode(text, num_threads=1), np.int32)


class CharacterMap:
    """Longest-prefix look-ups in a compiled map: the size of the trie, its units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.trie = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.text = np.frombuffer(blob, np.uint8, offset=4 + size)
        zeros = np.flatnonzero(self.text == 0)
        self.end_of = zeros[np.minimum(np.searchsorted(zeros, np.arange(len(self.text))), max(len(zeros) - 1, 0))] if len(zeros) else np.zeros(0, np.int64)

    def longest(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """(bytes matched, place of the replacement) at every ``start``; nothing matches beyond ``stop``."""
        matched, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        live = np.arange(len(start))
        node = np.full(len(start), int(jump(self.trie[0])))
        depth = 0
        while len(live):
            ok = start[live] + depth < stop[live]
            live, node = live[ok], node[ok]
            byte = raw[start[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.trie[np.minimum(node, len(self.trie) - 1)]
            ok = (node < len(self.trie)) & ((unit & 0x800000FF) == byte)
            live, node, unit = live[ok], node[ok] ^ jump(unit[ok]), unit[ok]
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            matched[live[leaf]] = depth
            place[live[leaf]] = self.trie[node[leaf]] & 0x7FFFFFFF
        return matched, place


class Normaliser:
    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.char_map) if model.char_map else None

    def _replaced(self, offs: np.ndarray, raw: np.ndarray):
        """(start in the text, output pool, output place, output size) of the characters and matches, in order."""
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        size = np.diff(np.append(head, len(raw)))
        if self.map is None:
            return head, raw, head, size
        stop = offs[1:][np.searchsorted(offs, head, "right") - 1]
        matched, place = self.map.longest(raw, head, stop)
        taken = np.ones(len(head), bool)
        reach = 0  # matches of several characters hide those within; only they are looked at one by one
        for i in np.flatnonzero(matched > size).tolist():
            if head[i] >= reach:
                reach = int(head[i] + matched[i])
                taken[i + 1 : np.searchsorted(head, reach)] = False
        head, size, matched, place = head[taken], size[taken], matched[taken], place[taken]
        hit = matched > 0
        out_size = np.where(hit, self.map.end_of[np.where(hit, place, 0)] - place, size)
        return head, np.concatenate([raw, self.map.text]), np.where(hit, len(raw) + place, head), out_size

    def __call__(self, offs: np.ndarray, raw: np.ndarray):
        """(bounds, bytes, origin): normalised texts; origin has the place in ``raw`` of every byte, and of the end of each document.

        The origins of document i are ``origin[bounds[i] + i : bounds[i + 1] + i + 1]``.
        """
        m = self.model
        head, pool, place, size = self._replaced(offs, raw)
        out = ranges(pool, place, size)
        chunk = np.repeat(np.arange(len(head)), size)
        begin = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(head, offs)  # first chunk of each document
        origin = head[chunk]
        space = out == 0x20
        keep = np.ones(len(out), bool)
        filled = np.diff(first) > 0
        lead = offs[:-1].copy()  # where a document's dummy prefix comes from
        if m.reduce:
            doc_start = np.zeros(len(out) + 1, bool)
            doc_start[begin[first[:-1]]] = True
            before = np.concatenate([[True], space])[: len(out) + 1] | doc_start
            # leading run of spaces of a chunk: all bytes from the chunk's start are spaces
            spaces = np.concatenate([[0], np.cumsum(space)])
            run = space & (spaces[:-1] - spaces[begin[chunk]] == np.arange(len(out)) - begin[chunk])
            keep = ~(run & before[begin[chunk]])
            only = np.zeros(len(head), bool)
            single = np.flatnonzero(size == 1)
            only[single] = out[begin[single]] == 0x20
            solid = np.flatnonzero(~only)
            at = np.searchsorted(solid, first[:-1])
            have = np.append(solid, len(head))[at]
            filled = have < first[1:]
            lead = np.where(filled, head[np.minimum(have, max(len(head) - 1, 0))] if len(head) else lead, lead)
        bounds = np.concatenate([[0], np.cumsum(keep)])[begin[first]]
        out, origin, space = out[keep], origin[keep], space[keep]
        blank = SPACE if m.escape else b" "
        wide = np.where(space, len(blank), 1)
        if m.dummy_prefix:
            out, origin, space, wide = (np.insert(x, bounds[:-1][filled], y) for x, y in ((out, 0x20), (origin, lead[filled]), (space, True), (wide, len(blank))))
            bounds = bounds + np.concatenate([[0], np.cumsum(filled)])
        cum = np.concatenate([[0], np.cumsum(wide)])
        origin = np.repeat(origin, wide)
        at = cum[:-1][space]
        out = np.repeat(out, wide)
        for k, byte in enumerate(blank):
            out[at + k] = byte
        bounds = cum[bounds]
        stop = offs[1:].copy()
        if m.reduce:
            out, origin, bounds, stop = self._trimmed(out, origin, bounds, stop, blank)
        return bounds, out, np.insert(origin, bounds[1:], stop)

    @staticmethod
    def _trimmed(out, origin, bounds, stop, blank):
        """Without the white space that ends a document."""
        inside = ends_with(out, blank)
        part = np.zeros(len(out), bool)
        for k in range(1, len(blank) + 1):
            part |= np.append(inside, np.zeros(len(blank), bool))[k : k + len(out)]
        solid = np.flatnonzero(~part)
        last = np.append(solid, -1)[np.searchsorted(solid, bounds[1:]) - 1]
        end = np.where((last >= bounds[:-1]) & (last >= 0), last + 1, bounds[:-1])
        cut = end < bounds[1:]
        if cut.any():
            stop[cut] = origin[end[cut]]
            drop = np.zeros(len(out) + 1, np.int64)
            np.add.at(drop, end[cut], 1)
            np.add.at(drop, bounds[1:][cut], -1)
            stay = np.cumsum(drop)[:-1] == 0
            bounds = np.concatenate([[0], np.cumsum(stay)])[bounds]
            out, origin = out[stay], origin[stay]
        return out, origin, bounds, stop


class PieceEncoder:
    def __init__(self, model: Model):
        self.model, self.normalise = model, Normaliser(model)
        self.size = np.array([len(x) for x in model.normal], np.int64)
        self.cache = UnitCache(model.segmenter(), self.size)

    def encode(self, offs: np.ndarray, raw: np.ndarray):
        """(ids, first id of each document and one more, begin and end of each piece in its document's bytes)."""
        bounds, out, origin = self.normalise(offs, raw)
        begin = np.zeros(len(out), bool)
        if self.model.cuttable:
            after = ends_with(out, SPACE)
            begin[np.flatnonzero(after) - len(SPACE)] = True
            begin &= ~after[:-1]
        begin[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(begin)
        alone = np.ones(len(start), bool)
        if self.model.cuttable:
            # units may follow each other where they begin with white space and do not end with it
            alone = ~after[np.minimum(start + len(SPACE), len(out))] | after[np.append(start[1:], len(out))[: len(start)]]
        ids, size = self.cache.ids(out, start, alone)
        first = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, bounds)]
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        end = np.cumsum(self.size[ids])
        return ids, first, origin[end - self.size[ids] + doc] - offs[doc], origin[end + doc] - offs[doc]


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """row_key, doc_id, ids, begins, ends of every row of ``docs``: the pieces of its text and their spans in its UTF-8 bytes.

    Ids are those of the sentencepiece library without begin and end ids.  Null
    and empty texts have no pieces.  A piece that covers part of a replaced
    character begins or ends where that character begins.  Rows that repeat an id
    stay separate rows; null ids stay null; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches):
        encoder = PieceEncoder(Model(model_path))
        for b in K.chunks(batches, limit=1 << 19):
            ids, first, begins, ends = encoder.encode(*K.offsets_of(b.column("text")))
            yield pa.record_batch([b.column("row_key"), b.column("doc_id"), *(lists(x, first) for x in (ids, begins, ends))], names=["row_key", "doc_id", "ids", "begins", "ends"])
        del encoder
        K.give_back()

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ENCODED)


codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceDecoder:
    def __init__(self, model: Model):
        self.model = model
        texts = [model.unknown if k == UNKNOWN else x if k == BYTE else x.replace(SPACE, b" ") for x, k in zip(model.normal, model.kinds.tolist(), strict=True)]
        self.pool, self.start, self.size = pooled(texts)
        self.blank = np.array([k not in (BYTE, UNKNOWN) and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds.tolist(), strict=True)])
        self.control = model.kinds == CONTROL

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        size = self.size[ids]
        data = ranges(self.pool, self.start[ids], size).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])
        bounds = at[first].tolist()
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            # white space that encoding has put in front goes; where the model reduces it, all that precedes the first text
            for k in range(first[i], first[i + 1]) if self.model.dummy_prefix or self.model.reduce else ():
                if self.control[ids[k]]:
                    continue
                a += int(self.blank[ids[k]])
                if not self.blank[ids[k]] or size[k] > 1 or not self.model.reduce:
                    break
            # byte pieces on both sides of a control piece are no character
            apart = [x for x in at[first[i] : first[i + 1]][self.control[ids[first[i] : first[i + 1]]]].tolist() if a < x < b]
            out.append("".join(data[x:y].decode("utf-8", "each_byte") for x, y in zip([a, *apart], [*apart, b], strict=True)))
        return out


def few_tokens(batch, limit: int = 1 << 18):
    """The batch in runs of whole rows of about ``limit`` ids; a longer row stands alone."""
    ends = batch.column("ids").offsets.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = min(max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (row_key, doc_id, ids) with the library's decoding of ``ids`` as ``decoded``; null ids decode to an empty text."""

    def run(batches):
        decoder = PieceDecoder(Model(model_path))
        for batch in batches:
            for b in few_tokens(batch):
                ids = b.column("ids")
                first = ids.offsets.to_numpy().astype(np.int64)
                texts = decoder.decode(ids.values[first[0] : first[-1]].to_numpy(zero_copy_only=False), first - first[0])
                yield pa.record_batch([b.column("row_key"), b.column("doc_id"), ids, pa.array(texts, pa.string())], names=["row_key", "doc_id", "ids", "decoded"])
        del decoder
        K.give_back()

    return encoded.select("row_key", "doc_id", "ids").mapInArrow(run, "row_key long, doc_id long, ids array<int>, decoded string")
