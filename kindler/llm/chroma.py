"""Media columns: chroma audio fingerprints and alignment.

A WAV column becomes frames of twelve pitch classes; rectangle filters over the
integral image of the frames give two bits each, sixteen filters a packed 32-bit
integer for each frame.  Recordings that share integers vote for an offset; at
the offset with the most votes the bit errors decide.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written

WINDOW, HOP, WIDTH = 1024, 256, 6


def wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM."""
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def read_wav(blob: bytes | None):
    """(samples as floats, rate) of mono or stereo 16-bit PCM; (empty, 0) for anything else."""
    if not blob or len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        return np.zeros(0), 0
    at, kind, rate, channels, bits = 12, 0, 0, 1, 0
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack("<I", blob[at + 4 : at + 8])[0]
        body = blob[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        if name == b"data":
            if kind != 1 or bits != 16 or channels < 1:
                return np.zeros(0), 0
            x = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            return x.mean(axis=1) / 32768, rate
        at += 8 + size + size % 2
    return np.zeros(0), 0


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """frames x 12: energy by pitch class, each frame of length one, smoothed over five frames."""
    n = 1 + (len(samples) - WINDOW) // HOP if len(samples) >= WINDOW else 0
    if n < 1 or not rate:
        return np.zeros((0, 12))
    at = np.arange(n)[:, None] * HOP + np.arange(WINDOW)
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(WINDOW), axis=1)) ** 2
    freq = np.fft.rfftfreq(WINDOW, 1 / rate)
    use = (freq > 60) & (freq < 4200)
    pitch = np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12
    fold = np.zeros((int(use.sum()), 12))
    fold[np.arange(len(pitch)), pitch] = 1
    c = np.sqrt(power[:, use] @ fold)
    smooth = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    padded = np.pad(c, ((2, 2), (0, 0)), mode="edge")
    c = sum(w * padded[k : k + n] for k, w in enumerate(smooth))
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), 0)


def filters():
    """Sixteen filters by a rule: (signed rectangles (sign, t0, t1, p0, p1)); four shapes over four pitch bands."""
    out = []
    for i in range(16):
        shape, band = i % 4, i // 4
        p, h, half = band * 3, (3, 4, 6, 4)[shape], WIDTH // 2
        p = min(p, 12 - h)
        m = p + h // 2
        if shape == 0:  # a band against all pitches
            out.append([(1.0, 0, WIDTH, p, p + h), (-h / 12, 0, WIDTH, 0, 12)])
        elif shape == 1:  # upper against lower half of the band
            out.append([(1.0, 0, WIDTH, m, p + h), (-1.0, 0, WIDTH, p, m)])
        elif shape == 2:  # later against earlier half
            out.append([(1.0, half, WIDTH, p, p + h), (-1.0, 0, half, p, p + h)])
        else:  # checkerboard
            out.append([(1.0, half, WIDTH, m, p + h), (1.0, 0, half, p, m), (-1.0, half, WIDTH, p, m), (-1.0, 0, half, m, p + h)])
    return out


_FILTERS = filters()
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """uint32 for each position of a ``WIDTH``-frame window; empty for audio that is too short."""
    c = chroma(samples, rate)
    n = len(c) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)
    out = np.zeros(n, np.uint32)
    for f in _FILTERS:
        v = sum(s * (image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]) for s, t0, t1, p0, p1 in f)
        area = sum(abs(s) * (t1 - t0) * (p1 - p0) for s, t0, t1, p0, p1 in f)
        level = np.searchsorted([-0.04, 0.0, 0.04], v / area * 2, "right")
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def fingerprints(recordings: DataFrame, id_col: str, wav_col: str) -> DataFrame:
    """rec long, fp array<int> (the integers as signed) of every row."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(*read_wav(x.as_py())) for x in b.column("w")]
            yield pa.record_batch([b.column("rec"), pa.array([x.view(np.int32) for x in fp], pa.list_(pa.int32()))], names=["rec", "fp"])

    return recordings.select(F.col(id_col).cast("long").alias("rec"), F.col(wav_col).alias("w")).mapInArrow(run, "rec long, fp array<int>")


#: Positions of queries in one block: what one recording meets at a time.
BLOCK_POSITIONS = 1 << 20
#: Pairs of runs that are laid out together; places of queries that travel in one list.
VOTES, LISTED = 200_000, 256


def runs_of(fp, value: str, at: str, length: str):
    """The runs of equal neighbours of an array that is not empty, as an array of structs."""
    starts = F.filter(F.sequence(F.lit(0), F.size(fp) - 1), lambda i: (i == 0) | (F.get(fp, i) != F.get(fp, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(fp)), F.array(F.size(fp)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(r["a"].alias(at), (r["b"] - r["a"]).alias(length), F.get(fp, r["a"]).alias(value)))


class Votes:
    """Votes of pairs of runs by (recording, block, query, offset), as changes of slope.

    A run of a recording and an equal one of a query vote for every pair of their
    places: as a function of the offset that is a trapezoid, which four changes of
    slope describe however long the runs are.
    """

    def __init__(self, c, block, q, d, w, n, qn):
        self.columns = [c, block, q, d, w, n, qn]

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, which) -> Votes:
        return Votes(*(x[which] for x in self.columns))

    @staticmethod
    def joined(parts: list) -> Votes:
        return Votes(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)))

    def combined(self) -> Votes:
        """Sorted by recording, query and offset, equal ones added up."""
        c, _, q, d, w, *_ = self.columns
        order = np.lexsort((d, q, c))
        c, q, d = c[order], q[order], d[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(c) != 0) | (np.diff(q) != 0) | (np.diff(d) != 0)]) if len(c) else np.zeros(0, np.int64)
        out = self.take(order).take(edge)
        out.columns[4] = np.add.reduceat(w[order], edge) if len(edge) else w
        return out

    def best(self):
        """(c, q, offset, n, qn) of each recording and query: most votes, then the smallest shift, then the smaller offset."""
        c, _, q, d, w, n, qn = self.combined().columns
        slope = np.cumsum(w)  # back at zero behind each recording and query
        last = np.r_[(np.diff(c) != 0) | (np.diff(q) != 0), True]
        end = np.where(last, d, np.r_[d[1:], 0] - 1)
        reached = np.cumsum(slope * np.where(last, 0, end - d + 1))  # votes at the end of each stretch
        before = np.r_[0, reached[:-1]]
        at = np.where(slope > 0, end, np.where(slope < 0, d, np.clip(0, d, end)))
        votes = np.where(slope > 0, reached, np.where(slope < 0, before + slope, before))
        order = np.lexsort((at, np.abs(at), -votes, q, c))
        first = order[np.r_[True, (np.diff(c[order]) != 0) | (np.diff(q[order]) != 0)]]
        return c[first], q[first], at[first], n[first], qn[first]


def _laid_out(batch):
    """Votes of rows (c, block, n, pos, len, asked), some rows at a time."""
    asked = batch.column("asked")
    size = asked.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(size)])
    places = asked.flatten()
    q, qn, at, run = (places.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("q", "qn", "at", "run"))
    c, block, n, pos, length = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("c", "block", "n", "pos", "len"))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + VOTES, "right")) - 1)
        rows = np.repeat(np.arange(start, end), size[start:end])
        own = slice(bounds[start], bounds[end])
        start = end
        first = pos[rows] - at[own] - run[own] + 1
        d = np.concatenate([first, first + length[rows], first + run[own], first + length[rows] + run[own]])
        w = np.repeat(np.array([1, -1, -1, 1]), len(first))
        yield Votes(np.tile(c[rows], 4), np.tile(block[rows], 4), np.tile(q[own], 4), d, w, np.tile(n[rows], 4), np.tile(qn[own], 4)).combined()


def aligned(batches, least_overlap: int):
    """Candidates from hits in the order of (c, block): what is open at a batch's end is its last recording and block."""

    def close(votes: Votes):
        c, q, off, n, qn = votes.best()
        begin, at_q = np.maximum(off, 0), np.maximum(-off, 0)
        overlap = np.minimum(n - begin, qn - at_q)
        ok = overlap >= least_overlap
        return pa.record_batch([pa.array(c[ok], pa.int64()), pa.array(q[ok], pa.int64()), *(pa.array(x[ok], pa.int32()) for x in (off, begin, at_q, overlap))], names=["c", "q", "offset", "begin", "at", "overlap"])

    held: list = []
    for batch in batches:
        for votes in _laid_out(batch) if batch.num_rows else ():
            held.append(votes)
            if sum(map(len, held)) > 4 * VOTES:
                held = [Votes.joined(held).combined()]
        if not held:
            continue
        every = Votes.joined(held)
        c, block = every.columns[:2]
        open_ = (c == batch.column("c")[-1].as_py()) & (block == batch.column("block")[-1].as_py()) if batch.num_rows else np.ones(len(c), bool)
        if not open_.all():
            yield close(every.take(~open_))
        held = [every.take(open_)]
    if held and len(held[0]):
        yield close(Votes.joined(held))


MATCHES = "array<struct<query_id:bigint,queries:bigint,offset:int,bit_errors:int,bits:int>>"


def search(prints: DataFrame, every: int = 20, most_errors: float = 0.2, least_overlap: int = 28) -> DataFrame:
    """rec, class_id, fp and matches of every row of ``prints`` (rec, fp), against the queries: rows whose rec is divisible by ``every``.

    An inverted join: rows with equal fingerprints are one class, and the integers
    of the classes meet those of the query classes by equi-join.  Runs of equal
    neighbours are one place with a length on both sides, so steady sound is few
    places.  The places of an integer in the queries travel as lists for each block
    of queries; hits are read in the order of recordings and blocks, and the votes
    of one recording and block are added up as they come.  A match is a
    query class that shares an integer with the row and has at most
    ``most_errors`` of its bits wrong at the offset (position in the row minus
    position in the query) with the most votes (ties: the smallest shift, then the
    smaller offset), over at least ``least_overlap`` positions.  No partners are
    left out.

    ``class_id`` is the smallest rec of the rows with the same fingerprints, null
    where there are none.  A match names its query class by the smallest query in
    it (``query_id``) and says how many query rows it has (``queries``); a query
    belongs to the match of its own ``class_id``.  The class whose only queries
    have the row's own rec is left out, so a row does not match itself.  Null and
    empty fingerprints match nothing, rows with a null rec are searched but are no
    queries, repeated ids are separate rows and separate queries.
    """
    own = F.col("rec") % every == 0
    label = F.md5(F.array_join(F.col("fp").cast("array<string>"), ","))
    rows = written(prints.select(F.monotonically_increasing_id().alias("row"), "rec", "fp", F.coalesce(label, F.lit("")).alias("print")))
    classes = rows.where(F.size("fp") > 0).groupBy("print").agg(
        F.first("fp").alias("fp"), F.min("rec").alias("class_id"), F.count(F.when(own, 1)).alias("queries"), F.min(F.when(own, F.col("rec"))).alias("query_id"), F.max(F.when(own, F.col("rec"))).alias("last")
    )
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "*"))  # stored, so the numbers stay the same
    asked = classes.where("queries > 0")
    places = classes.select("c", F.size("fp").alias("n"), F.inline(runs_of(F.col("fp"), "value", "pos", "len")))
    volume = asked.agg(F.sum(F.size("fp"))).first()[0] or 0
    block = F.pmod(F.xxhash64("q"), F.lit(1 + volume // BLOCK_POSITIONS)).alias("block")
    sought = asked.select(F.col("c").alias("q"), F.size("fp").alias("qn"), F.inline(runs_of(F.col("fp"), "value", "at", "run")))
    sought = sought.groupBy("value", block).agg(F.collect_list(F.struct("q", "qn", "at", "run")).alias("all"))
    lists = F.transform(F.sequence(F.lit(0), F.ceil(F.size("all") / LISTED).cast("int") - 1), lambda i: F.slice("all", i * LISTED + 1, F.lit(LISTED)))
    sought = sought.select("value", "block", F.posexplode(lists).alias("list", "asked"))
    hits = hot_join(places, sought, "value", ["c", "pos"], ["block", "list"]).select("c", "block", "n", "pos", "len", "asked")
    run = lambda batches: aligned(batches, least_overlap)
    dealt = hits.repartition("c", "block").sortWithinPartitions("c", "block")
    best = written(dealt.mapInArrow(run, "c long, q long, offset int, begin int, at int, overlap int"))
    pairs = hot_join(best, classes.select("c", "fp"), "c", ["q"], ["c"])
    pairs = hot_join(pairs, asked.select(F.col("c").alias("q"), F.col("fp").alias("qfp"), "queries", "query_id", "last"), "q", ["c"], ["q"], counted=best)
    # integers are signed: the mask keeps the sign from counting as 32 more bits
    wrong = F.zip_with(F.slice("fp", F.col("begin") + 1, F.col("overlap")), F.slice("qfp", F.col("at") + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    errors = F.aggregate(wrong, F.lit(0), lambda total, x: total + x)
    pairs = pairs.select("c", "query_id", "queries", "offset", errors.alias("bit_errors"), (F.col("overlap") * 32).alias("bits"), "last").where(F.col("bit_errors") <= most_errors * F.col("bits"))
    found = pairs.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("query_id", "queries", "offset", "bit_errors", "bits", "last"))).alias("found"))
    members = hot_join(rows, classes.select("c", "print", "class_id").join(found, "c", "left").drop("c"), "print", ["row"], ["print"], how="left")
    alone = lambda m: m["query_id"].eqNullSafe(F.col("rec")) & m["last"].eqNullSafe(F.col("rec"))
    matches = F.transform(F.filter("found", lambda m: ~alone(m)), lambda m: F.struct(*(m[x].alias(x) for x in ("query_id", "queries", "offset", "bit_errors", "bits"))))
    return members.select("rec", "class_id", "fp", F.coalesce(matches, F.array().cast(MATCHES)).cast(MATCHES).alias("matches"))


def melody(vectors: np.ndarray, rate: int = 4000, slots: int = 32, samples: int = 512) -> list[bytes]:
    """WAV bytes for each vector: twelve tones of an octave whose loudness follows the vector, slot by slot."""
    n, d = vectors.shape
    which = (np.arange(slots)[:, None] * 5 + np.arange(12)[None, :] * 7) % max(1, d)
    scale = vectors.std(axis=1, keepdims=True)
    x = np.clip(vectors / np.maximum(scale, 1e-12), -4, 4)
    loud = np.exp(0.8 * x[:, which])
    t = np.arange(slots * samples) / rate
    tones = np.sin(2 * np.pi * 261.63 * 2 ** (np.arange(12)[:, None] / 12) * t).reshape(12, slots, samples)
    sound = np.einsum("nsc,cst->nst", loud, tones, optimize=True).reshape(n, -1)
    top = np.abs(sound).max(axis=1, keepdims=True)
    return [wav(np.round(s), rate) for s in sound / np.maximum(top, 1e-12) * 30000]


def rendered(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rec, wav: a recording for each vector, so that the fingerprints have media to work on; null or empty vectors give null."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                lists = part.column("v").to_pylist()
                out: list = [None] * len(lists)
                for d in {len(v) for v in lists if v}:
                    good = [j for j, v in enumerate(lists) if v and len(v) == d]
                    made = melody(np.nan_to_num(np.array([lists[j] for j in good], np.float64)))
                    for j, w in zip(good, made, strict=True):
                        out[j] = w
                yield pa.record_batch([part.column("rec"), pa.array(out, pa.binary())], names=["rec", "wav"])

    return embeddings.select(F.col(id_col).cast("long").alias("rec"), F.col(vector_col).alias("v")).mapInArrow(run, "rec long, wav binary")


