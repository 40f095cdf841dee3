"""Chroma audio fingerprints and their alignment.

Sound becomes frames of energy by pitch class. Over the integral image of these frames, area filters compare
neighbouring blocks; each filter's value is cut into four levels, in Gray code, and sixteen filters make one
32-bit integer a frame. An inverted index of these integers gives hits between a probe and a recording; the
histogram of their offsets proposes alignments, and the share of differing bits over the overlap decides.

``sound_prints`` takes a column of sound (PCM or samples at any rate) and ``find`` aligns two tables of prints. The tables here have no sound, so the query renders each vector as a melody (a note a dimension). Every row is a
recording; every row whose id is divisible by 50 is also a probe, played with its first notes cut off and
with noise. Recordings with equal fingerprints are one class, and so are probes: the result has a row for each
vector with its classes, and a row for each aligned pair of a probe class and a recording class.

Nulls: a null or empty vector, or silence, has an empty fingerprint: such rows form one class that aligns with
nothing; nulls inside a vector count as 0. A class is named by its smallest id, null if it has none. Repeated rows are in one class. An empty table gives
an empty result, extra columns of any name aren't read. Ties between offsets go to more hits, then the smaller offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE, FRAME, HOP = 8000, 1024, 512
#: The pitch range that counts, and the pitch of class 0.
LOW, HIGH, TUNING = 100.0, 1000.0, 220.0
#: Frames under each filter, at most.
SPAN = 16
FILTERS = 16
#: Levels of a filter's value.
STEPS = np.array([-0.35, 0.0, 0.35])
#: Energy below which a frame is silent.
SILENCE = 1e-6
#: An alignment needs so many hits at its offset, so many frames of overlap, and no more than this share of bits.
LEAST_HITS, LEAST_FRAMES, MOST_ERROR = 2, 24, 0.15
QUERY_EVERY, CUT_NOTES, NOISE = 50, 7, 0.02

GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters(n: int = FILTERS) -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of each filter, by rule: kinds in turn, sizes spread over the span and the octave."""
    out = []
    for k in range(n):
        height = 2 + (k * 5) % 11
        out.append((k % 5, (k * 7) % (13 - height), height, 4 + (k * 3) % (SPAN - 3)))
    return out


def chroma(sound: np.ndarray) -> np.ndarray:
    """Frames x 12 shares of energy by pitch class; silent frames are zero."""
    if len(sound) == 0:
        return np.zeros((0, 12))
    sound = np.concatenate([sound, np.zeros(max(FRAME - HOP, FRAME - len(sound)))])
    parts = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP] * np.hanning(FRAME)
    energy = np.abs(np.fft.rfft(parts, axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = (pitch > LOW) & (pitch < HIGH)
    classes = np.round(12 * np.log2(pitch[heard] / TUNING)).astype(int) % 12
    c = energy[:, heard] @ np.eye(12)[classes]
    total = c.sum(axis=1, keepdims=True)
    return np.where(total > SILENCE, c / np.maximum(total, SILENCE), 0.0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each full span of frames."""
    n = len(frames) - SPAN + 1
    if n <= 0 or not frames.any():
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    x = np.arange(n)

    def area(x0: np.ndarray, x1: np.ndarray, y0: int, y1: int) -> np.ndarray:
        return image[x1, y1] - image[x0, y1] - image[x1, y0] + image[x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        y1, mid, half, third = y + h, y + h // 2, x + w // 2, w // 3
        whole = area(x, x + w, y, y1)
        if kind == 0:  # upper against lower classes
            a = area(x, x + w, y, mid)
        elif kind == 1:  # early against late frames
            a = area(x, half, y, y1)
        elif kind == 2:  # diagonal quarters
            a = area(x, half, y, mid) + area(half, x + w, mid, y1)
        elif kind == 3:  # middle frames against the outer ones
            a = area(x + third, x + w - third, y, y1)
        else:  # the block against all classes of its frames
            a, whole = whole, area(x, x + w, 0, 12)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(whole - a, 0))
        out = out << np.uint32(2) | GRAY[np.searchsorted(STEPS, value)]
    return out


def melody(vector: np.ndarray) -> np.ndarray:
    """A note for each dimension: its value sets pitch and loudness."""
    note = np.floor((vector + 0.5) * 24).astype(np.int64) % 12
    pitch = np.repeat(TUNING * 2 ** (note / 12), HOP)
    return np.sin(np.cumsum(2 * np.pi * pitch / RATE)) * np.repeat(0.2 + np.minimum(np.abs(vector), 1), HOP)


def probe_of(sound: np.ndarray) -> np.ndarray:
    """The sound without its first notes, with the same noise each time."""
    part = sound[CUT_NOTES * HOP :]
    return part + NOISE * np.random.default_rng(1).standard_normal(len(part))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, frames of overlap) with b[offset] under a[0]."""
    start = max(0, -offset)
    n = min(len(a) - start, len(b) - offset - start)
    if n <= 0:
        return 1.0, 0
    x = a[start : start + n] ^ b[start + offset : start + offset + n]
    return float(np.bitwise_count(x).sum()) / (32 * n), n


def prints(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, print, probe) of all rows: fingerprints as little-endian 32-bit numbers; probe is null where the row isn't a query."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own, probes = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                sound = melody(np.nan_to_num(np.array([x or 0.0 for x in v or ()], float)))
                own.append(fingerprint(chroma(sound)).astype("<u4").tobytes())
                probes.append(fingerprint(chroma(probe_of(sound))).astype("<u4").tobytes() if i is not None and i % QUERY_EVERY == 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary()), pa.array(probes, pa.binary())], ["id", "print", "probe"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, print binary, probe binary")


def samples(cell: bytes | list | None, rate: int = RATE) -> np.ndarray:
    """A sound cell as samples at ``RATE``: bytes are 16-bit little-endian mono PCM, lists are samples in -1 to 1; null is silence of no length, null samples are 0."""
    if cell is None or len(cell) == 0:
        return np.zeros(0)
    if isinstance(cell, (bytes, bytearray)):
        sound = np.frombuffer(bytes(cell[: len(cell) // 2 * 2]), "<i2") / 32768.0
    else:
        sound = np.nan_to_num(np.array([x or 0.0 for x in cell], float))
    if rate == RATE or not len(sound):
        return sound
    if rate > RATE:
        # what the lower rate can't hold goes before samples are left out
        wide = -(-rate // RATE)
        sound = np.convolve(sound, np.ones(wide) / wide, "same")
    return np.interp(np.arange(int(len(sound) * RATE / rate)) * rate / RATE, np.arange(len(sound)), sound)


def sound_prints(rows: DataFrame, id_col: str, sound_col: str, rate: int = RATE) -> DataFrame:
    """(id, print) of a column of sound, binary PCM or arrays of samples, recorded at ``rate``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lots(it):
            own = [fingerprint(chroma(samples(x.as_py(), rate))).astype("<u4").tobytes() for x in b.column("sound")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], ["id", "print"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(sound_col).alias("sound")).mapInArrow(run, "id long, print binary")


def find(probes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(probe_id, match_id, offset, hits, frames, bit_error) of fingerprints (id, print); equal fingerprints are one class, named by its smallest id."""
    return align(common.store(_classes(probes, "print"), "probes"), common.store(_classes(recordings, "print"), "recordings"))


def _frames(classes: DataFrame, name: str) -> DataFrame:
    """(key, at, name): every integer of each class's fingerprint."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for c, p in zip(b.column("c").to_pylist(), b.column("p").to_pylist(), strict=True):
                x = np.frombuffer(p, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.arange(len(x))), pa.array(np.full(len(x), c))], ["key", "at", name])

    return classes.mapInArrow(run, f"key long, at long, {name} long")


def _classes(found: DataFrame, col: str) -> DataFrame:
    """(c, p): the smallest id of each fingerprint."""
    return found.filter(F.col(col).isNotNull()).groupBy(F.sha2(col, 256).alias("digest")).agg(F.coalesce(F.min("id"), F.lit(common.NO_ID)).alias("c"), F.first(col).alias("p"))


def align(probes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(probe_id, match_id, offset, hits, frames, bit_error) of classes (c, p) that align."""
    hits = _frames(probes, "q").withColumnRenamed("at", "qa").join(_frames(recordings, "r"), "key")
    counted = hits.groupBy("q", "r", (F.col("at") - F.col("qa")).alias("offset")).agg(F.count("*").alias("hits")).filter(F.col("hits") >= LEAST_HITS)
    both = counted.join(probes.select(F.col("c").alias("q"), F.col("p").alias("qp")), "q").join(recordings.select(F.col("c").alias("r"), F.col("p").alias("rp")), "r")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [bit_error(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), o) for x, y, o in zip(b.column("qp").to_pylist(), b.column("rp").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("q", "r", "offset", "hits")), pa.array([n for _, n in found], pa.int64()), pa.array([e for e, _ in found], pa.float64())], ["q", "r", "offset", "hits", "frames", "bit_error"])

    tried = both.mapInArrow(run, "q long, r long, offset long, hits long, frames long, bit_error double")
    good = tried.filter((F.col("frames") >= LEAST_FRAMES) & (F.col("bit_error") <= MOST_ERROR))
    best = F.min_by(F.struct("offset", "hits", "frames", "bit_error"), F.struct("bit_error", -F.col("hits"), "offset")).alias("b")
    return good.groupBy(F.col("q").alias("probe_id"), F.col("r").alias("match_id")).agg(best).select("probe_id", "match_id", "b.*")


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Membership rows (vec_id, class_id, probe_id) and alignment rows (probe_id, match_id, offset, hits, frames, bit_error)."""
    found = common.store(prints(rows, id_col, vector_col), "prints")
    recordings = common.store(_classes(found, "print"), "recordings")
    probes = common.store(_classes(found, "probe"), "probes")
    aligned = align(probes, recordings)
    own = found.select("id", F.sha2("print", 256).alias("digest"), F.sha2("probe", 256).alias("pd"))
    member = own.join(recordings.select("digest", F.col("c").alias("class_id")), "digest", "left").join(probes.select(F.col("digest").alias("pd"), F.col("c").alias("probe_id")), "pd", "left")
    out = member.select(F.lit("member").alias("kind"), F.col("id").alias("vec_id"), "class_id", "probe_id").unionByName(aligned.withColumn("kind", F.lit("match")), allowMissingColumns=True)
    # a class of rows without ids has none either
    return out.withColumns({c: F.nullif(F.col(c), F.lit(common.NO_ID)) for c in ("class_id", "probe_id", "match_id")})


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
