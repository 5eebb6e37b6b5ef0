"""Fill-in-middle transformation by a table-driven byte automaton.

One scan over the bytes of a whole batch moves through states that know whether
the last character was white space, how many continuation bytes are due and how
much of a sentinel has been read.  Every transition emits flags that are counted: a
character begins, a unit begins, a sentinel ends.  A second pass looks up the
places of the emitted unit starts where a document is to be cut.

The scan is vectorised over blocks: each block is run from all states, the states
at block borders follow from these tables, and each block is run again from the
state it really starts in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Sentinels of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SCHEMA = "row_key long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

# states: at a document's start, after white space, after other characters, "<" read, "<" and a letter read, 1 to 3 continuation bytes due
_START, _SPACE, _WORD, _OPEN, _LETTER, _ONE, _TWO, _THREE = range(8)
# classes of bytes, and the end of a document
_BLANK, _LESS, _MARK, _MORE, _PLAIN, _CONTINUE, _LEAD2, _LEAD3, _LEAD4, _END = range(10)
CHARACTER, UNIT, SENTINEL = 1, 2, 4


def _tables():
    """(class of each byte, next state and emitted flags by class and state)."""
    kind = np.full(256, _PLAIN, np.uint8)
    kind[K.SPACES] = _BLANK
    kind[[ord("<"), ord(">")]] = _LESS, _MORE
    kind[[ord("P"), ord("S"), ord("M")]] = _MARK
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = _CONTINUE, _LEAD2, _LEAD3, _LEAD4
    step, emit = np.zeros((10, 8), np.uint8), np.zeros((10, 8), np.uint8)
    plain = {_BLANK: _SPACE, _LESS: _OPEN, _MARK: _WORD, _MORE: _WORD, _PLAIN: _WORD, _LEAD2: _ONE, _LEAD3: _TWO, _LEAD4: _THREE}
    for c, to in plain.items():
        step[c], emit[c] = to, CHARACTER
        emit[c, _START] |= UNIT
    emit[_BLANK, _WORD:] |= UNIT  # white space after other characters begins a unit
    step[_MARK, _OPEN] = _LETTER
    emit[_MORE, _LETTER] |= SENTINEL
    step[_CONTINUE, [_THREE, _TWO, _ONE]] = _TWO, _ONE, _WORD
    step[_CONTINUE, :_ONE] = _WORD
    step[_END] = _START
    return kind, step, emit


KIND, STEP, EMIT = _tables()
_BLOCK = 512


def scan(offs: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Flags emitted at every byte; documents are scanned apart."""
    kinds = np.insert(KIND[raw], offs[1:], _END)
    n = len(kinds)
    blocks = -(-n // _BLOCK)
    lanes = np.full(blocks * _BLOCK, _END, np.uint8)
    lanes[:n] = kinds
    lanes = np.ascontiguousarray(lanes.reshape(blocks, _BLOCK).T)
    flat = STEP.ravel()
    to = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    base = lanes.astype(np.uint8) << 3
    for row in base:
        to = flat[row | to]
    begin, state = np.zeros(blocks, np.uint8), _START
    ends = to.T.tolist()
    for i in range(blocks):
        begin[i] = state
        state = ends[i][state]
    flags, at, now = np.empty_like(lanes), EMIT.ravel(), begin
    for k, row in enumerate(base):
        place = row | now
        flags[k] = at[place]
        now = flat[place]
    flags = flags.T.ravel()[:n]
    return np.delete(flags, offs[1:] + np.arange(len(offs) - 1))


def draws(doc_id, seed: int) -> tuple[int, ...]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of ``seed:doc_id``; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """row_key, doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs``.

    A unit is a run of white space with the run of other characters that follows
    it, or the white space that ends a text; ``n`` is their number.  By hash draws
    of the id a text stays plain, or is cut at two units into prefix, middle and
    suffix, which are ordered as prefix-suffix-middle (psm) or suffix-prefix-middle
    (spm) behind sentinels.  Texts that are null, empty or hold a sentinel stay
    plain, with null cuts.  Rows that repeat an id stay separate rows, cut by the
    same draws; null ids draw as an empty id; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches):
        for b in K.chunks(batches, limit=1 << 20):
            offs, raw = K.offsets_of(b.column("text"))
            flags = scan(offs, raw)
            unit_at = np.flatnonzero(flags & UNIT)
            first = np.searchsorted(unit_at, offs)
            marked = np.diff(np.concatenate([[0], np.cumsum((flags & SENTINEL) > 0)])[offs]) > 0
            chars = np.concatenate([[0], np.cumsum(flags & CHARACTER, dtype=np.int64)])
            count = np.diff(first)
            drawn = [draws(d, seed) for d in b.column("doc_id").to_pylist()]
            h = np.array(drawn, np.int64).reshape(-1, 4)
            plain = (np.diff(offs) == 0) | marked | (h[:, 2] % 100 >= fim_percent)
            spm = ~plain & (h[:, 3] % 100 < spm_percent)
            # second pass: the n-th unit's start is the cut; behind the last unit the text's end
            ends = np.append(unit_at, len(raw))
            place = lambda k: np.where(k < count, ends[np.minimum(first[:-1] + k, len(unit_at))], offs[1:])
            one, two = h[:, 0] % (count + 1), h[:, 1] % (count + 1)
            a, z = place(np.minimum(one, two)), place(np.maximum(one, two))
            data = raw.tobytes()
            out = []
            for i, (s, x, y, e) in enumerate(zip(offs[:-1].tolist(), a.tolist(), z.tolist(), offs[1:].tolist(), strict=True)):
                if plain[i]:
                    out.append(data[s:e])
                elif spm[i]:
                    out.append(b"".join((SUFFIX, data[y:e], PREFIX, data[s:x], MIDDLE, data[x:y])))
                else:
                    out.append(b"".join((PREFIX, data[s:x], SUFFIX, data[y:e], MIDDLE, data[x:y])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.record_batch(
                [b.column("row_key"), b.column("doc_id"), pa.array(count), pa.array(form.tolist(), pa.string()), pa.array(chars[a] - chars[offs[:-1]], mask=plain), pa.array(chars[z] - chars[a], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)


def restore(made: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``restored``: the exact texts, rebuilt from ``output`` and ``form`` alone by the same automaton.

    A text that was cut holds no sentinel, so the three that the automaton finds
    are those put in.  Plain outputs and null ones come back as they are.
    """
    spark_types = {f.name: f.dataType.simpleString() for f in made.schema}

    def run(batches):
        for b in K.chunks(batches, "output", limit=1 << 20):
            offs, raw = K.offsets_of(b.column("output"))
            ends = np.flatnonzero(scan(offs, raw) & SENTINEL) + 1
            first = np.searchsorted(ends, offs, "right")
            data = raw.tobytes()
            out = []
            for i, form in enumerate(b.column("form").to_pylist()):
                s, e = int(offs[i]), int(offs[i + 1])
                if form not in ("psm", "spm"):
                    out.append(data[s:e])
                    continue
                x, y, z = (int(v) for v in ends[first[i] : first[i] + 3])
                one, two, middle = data[x : y - 3], data[y : z - 3], data[z:e]
                out.append(one + middle + two if form == "psm" else two + middle + one)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(out, pa.binary()).cast(pa.string())], names=[*keep, "restored"])

    schema = ", ".join([*(f"`{c}` {spark_types[c]}" for c in keep), "restored string"])
    return made.select(*dict.fromkeys([*keep, "form", "output"])).mapInArrow(run, schema)
