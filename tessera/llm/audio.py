"""Operator 9, chroma fingerprints of audio columns.

1. A recording (WAV of 8, 16, 24 or 32 bits) is cut into frames of about ``FRAME_S`` seconds every ``HOP_S``; a frame's spectrum is folded into
   12 pitch classes, smoothed over five frames and scaled to length 1.
2. Filters, differences of rectangle sums, are read off an integral image of (frames x pitch classes) at each frame.
   Each of 16 filters is quantised to two bits by the logarithm of its two sums; the bits are packed into a 32-bit integer (Gray code).
3. Search: equal fingerprints are one class. The queries go out in blocks of ``BLOCK`` integers and meet every class at every offset at
   which half of the shorter one or more is aligned; bit errors are counted by a matrix product of signs. A class is found if an
   offset has a share of bit errors of ``max_error`` or less; the offset with the least share aligns them. No pair and no offset is left out.

Nulls and empties: a null, empty or undecodable recording has no integers and matches nothing; a recording shorter than a filter
likewise. Null identifiers are kept. Repeated rows are one class. Ties between offsets go to the smaller distance, then the smaller offset. Very long recordings are read
whole, some frames at a time. A class whose recordings all have null ids is named null. An empty table gives no rows. Other columns aren't read."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME_S, HOP_S = 0.256, 0.128
LOW_HZ, HIGH_HZ = 50.0, 3500.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
MAX_ERROR = 0.2
#: Integers of queries, or of classes, that are compared at once (a single longer recording is a block of its own).
BLOCK = 32_768
WIDTH = 16
#: Limits between the four values of a filter, in log units.
LIMITS = np.array([-0.25, 0.0, 0.25])


@cache
def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the 16 filters, by rule: four kinds, each over four bands and widths. Kind 0 sets the
    upper half of the classes against the lower, 1 the later half of the frames against the earlier, 2 crosswise quarters, 3 the middle third of the frames against the rest."""
    return [(kind, (3 * k + kind) % 9, 4, (4, 8, 12, 16)[k]) for kind in range(4) for k in range(4)]


def decode(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples, scaled as 16 bits are, and their rate; none if it isn't such a WAV."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            width, n = w.getsampwidth(), w.getnchannels()
            data = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
            data = data[: len(data) // (width * n) * width * n].reshape(-1, width)
            if width == 1:  # unsigned
                x = (data[:, 0].astype(np.float32) - 128) * 256
            else:
                wide = np.zeros((len(data), 4), np.uint8)
                wide[:, 4 - width :] = data
                x = (wide.view("<i4")[:, 0] / 65536).astype(np.float32)
            return x.reshape(-1, n).mean(axis=1), w.getframerate()
    except (EOFError, wave.Error, ValueError):
        return np.empty(0, np.float32), 1


@cache
def _fold(rate: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    size = 1 << max(6, round(np.log2(FRAME_S * rate)))
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    to = np.zeros((len(use), 12), np.float32)
    to[np.arange(len(use)), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return size, max(1, round(HOP_S * rate)), use, to


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12, smoothed, of length 1."""
    size, hop, use, to = _fold(rate)
    n = (len(samples) - size) // hop + 1
    if n < 5:
        return np.empty((0, 12))
    window = np.hanning(size).astype(np.float32)
    out = []
    for at in range(0, n, 256):  # so many frames at a time, however long the recording
        k = min(256, n - at)
        frames = np.lib.stride_tricks.as_strided(samples[at * hop :], (k, size), (samples.strides[0] * hop, samples.strides[0]))
        out.append(np.abs(np.fft.rfft(frames * window)[:, use]) ** 2 @ to)
    c = np.concatenate(out)
    c = sum(w * c[k : len(c) - 4 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((c**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0.0)


def fingerprint(raw: bytes | None) -> np.ndarray:
    """The packed integers of a recording."""
    c = chroma(*decode(raw))
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        half, mid = w // 2, y + h // 2
        if kind == 0:
            a, b = area(0, w, mid, y + h), area(0, w, y, mid)
        elif kind == 1:
            a, b = area(half, w, y, y + h), area(0, half, y, y + h)
        elif kind == 2:
            a, b = area(0, half, y, mid) + area(half, w, mid, y + h), area(0, half, mid, y + h) + area(half, w, y, mid)
        else:
            third = max(1, w // 3)
            a = area(third, w - third, y, y + h)
            b = area(0, w, y, y + h) - a
        level = np.searchsorted(LIMITS, np.log((a + 0.01) / (b + 0.01))).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """id, fp (little-endian unsigned 32-bit integers), fp_class (a digest of them, null if there are none)."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.binary()), ("fp_class", pa.binary())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for batch in batches:
            for part in common.slices(batch, "audio"):
                fps = [fingerprint(x).astype("<u4").tobytes() for x in part.column("audio").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) if x else None for x in fps], pa.binary())], schema=schema)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInArrow(tell, "id long, fp binary, fp_class binary")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Bit errors and bits of a against b, where a's place i stands at b's i + offset."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    if end <= start:
        return 0, 0
    return int(np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum()), 32 * (end - start)


def blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (name, fp, ...) in lists of BLOCK integers at most, or of one row."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        n = len(row[1]) // 4
        if held and size + n > BLOCK:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def by_length(fps: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the places of the fingerprints that have it and their bits as signs, a row per fingerprint."""
    sizes = np.array([len(x) for x in fps])
    out = []
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        bits = np.unpackbits(np.frombuffer(b"".join(fps[k] for k in own), np.uint8)).reshape(len(own), n * 8)
        out.append((own, bits.astype(np.float32) * 2 - 1))
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of signs, exact: float32 holds whole numbers up to 2 ** 24."""
    step = 1 << 23
    if a.shape[1] <= step:
        return a @ b.T
    return sum((a[:, k : k + step] @ b[:, k : k + step].T).astype(np.float64) for k in range(0, a.shape[1], step))


def compared(a: np.ndarray, b: np.ndarray, max_error: float) -> tuple[np.ndarray, ...]:
    """Rows of a and of b that match, with the offset, the bit errors and the bits of the best alignment."""
    la, lb = a.shape[1] // 32, b.shape[1] // 32
    best = np.full(len(a) * len(b), np.inf)
    kept = np.zeros((3, len(best)), np.int64)
    for offset in sorted(range(1 - la, lb), key=lambda o: (abs(o), o)):
        start, end = max(0, -offset), min(la, lb - offset)
        if 2 * (end - start) < min(la, lb):
            continue
        bits = 32 * (end - start)
        same = _product(a[:, 32 * start : 32 * end], b[:, 32 * (start + offset) : 32 * (end + offset)]).ravel()
        hit = np.flatnonzero(same >= bits - 2 * int(max_error * bits))
        errors = ((bits - same[hit]) / 2).astype(np.int64)
        better = errors / bits < best[hit]
        hit, errors = hit[better], errors[better]
        best[hit] = errors / bits
        kept[:, hit] = np.array([np.full(len(hit), offset), errors, np.full(len(hit), bits)])
    found = np.flatnonzero(best < np.inf)
    return found // len(b), found % len(b), *kept[:, found]


def search(media: DataFrame, id_col: str = "vec_id", audio_col: str = "audio", every: int = 50, max_error: float = MAX_ERROR) -> DataFrame:
    """Rows of two sorts. A row per recording: id, class_id (the smallest id with an equal fingerprint) and n_integers, with match_id, offset,
    errors and bits null. And, of each class that holds a query (an id divisible by ``every``), a row per class found, its own included: the class's
    smallest id as id and class_id, n_integers, the smallest id of the class found, and the alignment's offset, bit errors and bits. Copies aren't expanded into pairs."""
    spark = media.sparkSession
    common.small_batches(spark)
    known = common.written(fingerprints(media, id_col, audio_col), "fingerprints")
    classes = known.where("fp_class is not null").groupBy("fp_class").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.max((F.col("id") % every == 0).cast("int")).alias("asked"), F.count("*").alias("members"))
    classes = common.written(classes, "classes")
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("match_id", pa.int64()), ("offset", pa.int32()), ("errors", pa.int64()), ("bits", pa.int64())])
    shape = "q long, n long, match_id long, offset int, errors long, bits long"
    # Work goes with the rows, not with their few bytes.
    dealt = classes.select("class_id", "fp").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame([], shape)
    for block in blocks((r[0], bytes(r[1])) for r in classes.where("asked = 1").select("class_id", "fp").toLocalIterator()):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            common.begin()
            names, sizes = [name for name, _ in shared.value], [len(fp) // 4 for _, fp in shared.value]
            asked = by_length([fp for _, fp in shared.value])
            for held in blocks(row for batch in batches for row in zip(batch.column("class_id").to_pylist(), batch.column("fp").to_pylist(), strict=True)):
                for of_c, b in by_length([fp for _, fp in held]):
                    for of_q, a in asked:
                        q, c, offset, errors, bits = compared(a, b, max_error)
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in of_q[q]], pa.int64()), pa.array([sizes[k] for k in of_q[q]], pa.int64()), pa.array([held[k][0] for k in of_c[c]], pa.int64()), pa.array(offset, pa.int64()).cast(pa.int32()), pa.array(errors), pa.array(bits)], schema=schema)

        found = found.unionByName(dealt.mapInArrow(judge, shape))
    size = (F.length("fp") / 4).cast("long").alias("n_integers")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("match_id", "long"), ("offset", "int"), ("errors", "long"), ("bits", "long"))]
    members = common.hot_join(known.where("fp_class is not null"), classes.select("fp_class", "class_id", "members"), "fp_class", "members")
    rows = members.select(F.col("id").alias(id_col), "class_id", size, *none).unionByName(known.where("fp_class is null").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"), size, *none))
    return rows.unionByName(found.select(F.col("q").alias(id_col), F.col("q").alias("class_id"), F.col("n").alias("n_integers"), "match_id", "offset", "errors", "bits"))


RATE = 4000


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A media column for tables of vectors: each number is a note of ``HOP_S`` seconds, its pitch one of 24 semitones by the
    number's rank among the vector's, its loudness by its size. A null or empty vector has null audio."""
    common.small_batches(vectors.sparkSession)

    def tones(x: np.ndarray) -> bytes:
        n = round(HOP_S * RATE)
        pitch = np.argsort(np.argsort(x, kind="stable"), kind="stable") * 24 // len(x)
        t = np.arange(n) / RATE
        loud = 0.3 + 0.7 * np.abs(x) / max(1e-9, float(np.abs(x).max()))
        tone = np.sin(2 * np.pi * 110 * 2 ** (pitch[:, None] / 12) * t[None, :]) * loud[:, None]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes((tone.ravel() * 12000).astype("<i2").tobytes())
        return out.getvalue()

    schema = pa.schema([(id_col, pa.int64()), ("audio", pa.binary())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                audio = []
                for v in part.column("v").to_pylist():
                    x = np.nan_to_num(np.array([0.0 if y is None else y for y in v or ()], float), posinf=0.0, neginf=0.0)
                    audio.append(tones(x) if len(x) else None)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(audio, pa.binary())], schema=schema)

    return vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(draw, f"{id_col} long, audio binary")
