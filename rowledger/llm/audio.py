"""Media columns: chroma fingerprints of recordings, aligned by offset histograms and bit errors.

Contract: one row per recording with vec_id, class_id (the smallest id with the same fingerprint), n_links (how many
query classes other than its own it aligns with), and the best of them: best_query, best_offset (frames by which the
query's start lies after the recording's), best_errors (share of wrong bits). Queries are the classes that hold an id
divisible by 100. Null audio, audio that is no 16-bit WAV and audio too short for one integer take no part: class_id
null, no links. Channels are averaged. Repeated rows count each; extra columns are ignored; an empty table gives an empty result.

Method. Signals of any rate are brought to RATE, so a frame is the same time in all. Frames of the signal give energies of the twelve pitch classes; over their integral image 16 filters compare two
areas in time and pitch, each comparison quantised to two bits in Gray code: one 32-bit integer per frame. Recordings
with equal fingerprints collapse into a class. Queries go in blocks of bounded size as a sorted list of integers; every class
looks all of its integers up, the matches' offsets are counted for each query, and of the offsets with `votes` matches
the one with fewest wrong bits over the frames that overlap there is kept if they are at most a share of `errors`. Nothing is capped: a common
integer makes matches in proportion to rows, which are counted in pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import materialize

#: Samples a second, up to 1,000 Hz; a frame is 0.128 s, with a bin every 7.8 Hz.
RATE, FRAME, HOP, FILTER_FRAMES = 2_000, 256, 128, 8
#: Queries of a block, and integers of all of them (20 hours of sound), on average.
BLOCK, BLOCK_INTS, MATCHES = 1_024, 1 << 20, 1 << 21
VOTES, OVERLAP, ERRORS = 4, 16, 0.2
#: Quantiser: comparisons below the first bound are 0, and so on.
BOUNDS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[str, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames): by rule, each kind over four bands of growing width and length."""
    return [(kind, 3 * i % 12, min(12 - 3 * i % 12, 3 + i), 2 + 2 * i) for kind in ("pitch", "time", "both", "middle") for i in range(4)]


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono WAV file."""
    data = np.asarray(samples, "<i2").tobytes()
    head = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little")
    return head + rate.to_bytes(4, "little") + (2 * rate).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + len(data).to_bytes(4, "little") + data


def samples_of(audio: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples, the mean of all channels, and rate of a 16-bit WAV file, else None."""
    if not audio or len(audio) < 12 or audio[:4] != b"RIFF" or audio[8:12] != b"WAVE":
        return None
    at, rate, channels = 12, 0, 0
    while at + 8 <= len(audio):
        name, size = audio[at : at + 4], int.from_bytes(audio[at + 4 : at + 8], "little")
        body = audio[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            channels, rate = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little")
            if body[:2] != b"\x01\x00" or body[14:16] != b"\x10\x00" or not channels:
                return None
        elif name == b"data" and rate:
            whole = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
            return whole.mean(1, dtype=np.float32), rate
        at += 8 + size + size % 2
    return None


def resampled(samples: np.ndarray, rate: int, taps: int = 16, block: int = 4_096) -> np.ndarray:
    """samples at RATE: a windowed sinc of `taps` zero crossings to each side, in blocks, so a long recording takes no more memory.
    Times repeat after RATE / gcd(rate, RATE) samples, so there is a kernel for each of those."""
    if rate == RATE or not len(samples):
        return samples
    phases = RATE // math.gcd(rate, RATE)
    cut = min(1.0, RATE / rate)
    half = math.ceil(taps / cut)
    around = np.arange(-half, half + 1)

    @cache
    def kernel(phase: int) -> np.ndarray:
        x = around - (phase * rate % RATE) / RATE
        k = np.sinc(x * cut) * np.where(np.abs(x) < half, np.cos(np.pi * x / (2 * half)) ** 2, 0)
        return (k / k.sum()).astype(np.float32)

    n = len(samples) * RATE // rate
    out, long = np.zeros(n, np.float32), np.pad(samples, half)
    for a in range(0, n, block):
        m = np.arange(a, min(n, a + block))
        seen = np.lib.stride_tricks.sliding_window_view(long, len(around))[m * rate // RATE]
        for p in range(min(phases, len(m))):
            out[a + p : a + len(m) : phases] = seen[p::phases] @ kernel(int(m[p] % phases))
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) shares of energy by pitch class."""
    samples = resampled(samples, rate)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = hz >= 55
    pitch = np.where(heard, np.round(12 * np.log2(np.maximum(hz, 1) / 440)).astype(int) % 12, 12)
    out, step = [], 4_096
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, len(frames), step):
        power = np.abs(np.fft.rfft(frames[i : i + step] * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
        out.append(power @ np.eye(13)[pitch][:, :12])
    e = np.concatenate(out)
    return e / np.maximum(e.sum(1, keepdims=True), 1e-9)


def packed(energies: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has FILTER_FRAMES frames from it on."""
    n = len(energies) - FILTER_FRAMES + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(energies) + 1, 13))
    image[1:, 1:] = energies.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(a: int, b: int, y: int, z: int) -> np.ndarray:
        return (image[t + b, z] - image[t + a, z] - image[t + b, y] + image[t + a, y]) / max(1, b - a)

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        half, mid = w // 2, y + h // 2
        if kind == "pitch":
            x, r = area(0, w, y, mid), area(0, w, mid, y + h)
        elif kind == "time":
            x, r = area(0, half, y, y + h), area(half, w, y, y + h)
        elif kind == "both":
            x, r = area(0, half, y, mid) + area(half, w, mid, y + h), area(0, half, mid, y + h) + area(half, w, y, mid)
        else:
            third = max(1, w // 3)
            x, r = area(third, w - third, y, y + h) if w - third > third else area(0, third, y, y + h), (area(0, third, y, y + h) + area(w - third, w, y, y + h)) / 2
        level = np.searchsorted(BOUNDS, np.log1p(x) - np.log1p(r))
        out = out << np.uint32(2) | GRAY[level]
    return out


def prints(recordings: DataFrame) -> DataFrame:
    """(vec_id, ints: little-endian unsigned 32-bit integers, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x in b.column(1):
                heard = samples_of(x.as_py())
                ints = packed(chroma(*heard)) if heard else np.zeros(0, np.uint32)
                made.append(ints.astype("<u4").tobytes() or None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["vec_id", "ints"])

    return recordings.select(F.col("vec_id").cast("long").alias("vec_id"), "audio").mapInArrow(run, "vec_id long, ints binary")


def links_of(query_ids: np.ndarray, query_ints: list[np.ndarray]):  # noqa: ANN201
    """A function that finds the links of classes (class_id, ints) with a block of queries."""
    sizes = np.array([len(x) for x in query_ints], np.int64)
    flat = np.concatenate(query_ints) if len(query_ints) else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(flat, kind="stable")
    keys, owner, place = flat[order], owner[order], place[order]

    def matches(ints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi = np.searchsorted(keys, ints, "left"), np.searchsorted(keys, ints, "right")
        found = np.flatnonzero(hi > lo)
        ends = np.cumsum((hi - lo)[found])
        a = 0
        while a < len(found):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATCHES, "right")))
            part = found[a:b]
            n = (hi - lo)[part]
            at = np.repeat(lo[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield owner[at], np.repeat(part, n) - place[at]
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(sizes.max(initial=0))
        for b in batches:
            rows = []
            for own, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ints = np.frombuffer(data, "<u4")
                width = span + len(ints) + 1
                voted = [np.unique(q * width + shift + span, return_counts=True) for q, shift in matches(ints)]
                if not voted:
                    continue
                k, at = np.unique(np.concatenate([x for x, _ in voted]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in voted])).astype(np.int64)
                best: dict[int, tuple[float, int, int]] = {}
                for x, c in zip(k[n >= VOTES].tolist(), n[n >= VOTES].tolist(), strict=True):
                    q, shift = x // width, x % width - span
                    a, e = max(0, shift), min(len(ints), shift + sizes[q])
                    if e - a < OVERLAP or query_ids[q] == own:
                        continue
                    wrong = float(np.bitwise_count(ints[a:e] ^ query_ints[q][a - shift : e - shift]).mean() / 32)
                    if wrong <= ERRORS:
                        best[q] = min(best.get(q, (2.0, 0, 0)), (wrong, -c, shift))
                rows += [(own, int(query_ids[q]), shift, -c, wrong) for q, (wrong, c, shift) in best.items()]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["class_id", "query", "offset", "votes", "errors"])

    return run


def align(recordings: DataFrame, every: int = 100) -> DataFrame:
    """recordings: vec_id, audio. The queries' ids are those divisible by `every`."""
    made = materialize(prints(recordings).withColumn("key", F.sha2("ints", 256)), "audio-prints")
    heard = made.where("ints is not null")
    asks = F.max(F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False))).alias("asks")
    # Of equal fingerprints any one serves.
    classes = heard.groupBy("key").agg(F.min("vec_id").alias("class_id"), F.min("ints").alias("ints"), asks)
    classes = materialize(classes, "audio-classes")
    asked, ints = classes.where("asks").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ints").cast("long")), F.lit(0))).first()
    blocks = max(-(-asked // BLOCK), -(-ints // (4 * BLOCK_INTS)))
    out = None
    for block in range(blocks):
        mine = classes.where("asks").where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("class_id", "ints").orderBy("class_id").collect()  # about BLOCK, or BLOCK_INTS integers
        run = links_of(np.array([r["class_id"] for r in mine], np.int64), [np.frombuffer(bytes(r["ints"]), "<u4") for r in mine])
        found = classes.where("class_id is not null").select("class_id", "ints").mapInArrow(run, "class_id long, query long, offset long, votes long, errors double")
        out = found if out is None else out.union(found)
    if out is None:
        return made.select("vec_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *[F.lit(None).cast(t).alias(n) for n, t in (("best_query", "long"), ("best_offset", "long"), ("best_errors", "double"))]) if not classes.take(1) else with_links(made, classes, None)
    return with_links(made, classes, out)


def with_links(made: DataFrame, classes: DataFrame, links: DataFrame | None) -> DataFrame:
    named = classes.select("key", "class_id")
    if links is not None:
        best = F.min(F.struct("errors", "query", "offset"))
        named = named.join(links.groupBy("class_id").agg(F.count("*").alias("n"), best.alias("best")), "class_id", "left")
    else:
        named = named.withColumn("n", F.lit(0).cast("long")).withColumn("best", F.lit(None).cast("struct<errors:double,query:bigint,offset:bigint>"))
    # The map has one row per class and no fingerprints; rows without one find no key.
    return made.select("vec_id", "key").join(named, "key", "left").select("vec_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("best.query").alias("best_query"), F.col("best.offset").alias("best_offset"), F.col("best.errors").alias("best_errors"))


def rendered(vectors: DataFrame, rate: int = RATE) -> DataFrame:
    """(vec_id, audio): each component of an embedding as a tone of HOP samples, from the (vec_id mod 5)-th on.

    The tables hold no sound, so recordings are derived from vectors: equal vectors are recordings of one melody that
    begin at different notes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(HOP) / rate
        tones = np.stack([8_000 * np.sin(2 * np.pi * 261.6256 * 2 ** (p / 12) * t) for p in range(12)])
        for b in batches:
            made = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                notes = x.values.to_numpy(zero_copy_only=False) if x.as_py() is not None else None
                if notes is None or not np.isfinite(notes.astype(float)).all():
                    made.append(None)
                else:
                    pitch = np.floor(np.clip(notes.astype(float), -1e6, 1e6) * 64).astype(np.int64) % 12
                    made.append(wav(tones[pitch[(i or 0) % 5 :]].reshape(-1), rate))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["vec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, audio binary")
