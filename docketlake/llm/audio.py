"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; each frame's spectrum is folded on the twelve pitch classes. The frames are
smoothed over time and normalised, and make an image of twelve columns. Filters that compare the sums of parts of a window,
read from the integral image, give two bits each; sixteen of them make the packed 32-bit integer of a
place. Filters are made by rule, thresholds are constants, so fingerprints of different runs compare.

Recordings with equal fingerprints are one class. The query classes are dealt to blocks of a bounded number of fingerprints. Their coarse
keys and those of all classes meet in a shuffled join, with keys that many recordings hold salted, which tells each class the blocks
that it shares a key with; only those are compared, in tiles of bounded size. There, places whose keys are equal
vote for an offset; the best offset of a pair is checked by the bit errors along it, and the longest stretch
with few errors is the match. Votes are counted some at a time, so a sound that repeats costs time and not memory.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BITMAP_BITS, bitmap, checkpoint, few_rows, marked, mix64, named, signed, slices

#: Samples per second, of a frame, and from frame to frame.
RATE, FRAME, HOP = 2048, 256, 128
#: Frames of a filter window, and weights of the smoothing over time.
WINDOW, SMOOTH = 16, np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Values of a filter between which its two middle levels lie.
THRESHOLD = 0.03
#: Frames of a match at least, share of wrong bits at most, fingerprints of a block of queries and of a tile's other side.
LEAST, ERROR, BLOCK, TILE = 16, 0.12, 100_000, 2_000_000
#: Recordings of one key in a salt, and votes that are counted at a time.
SALT, VOTES = 512, 1 << 20
#: Places, from the first, whose coarse values make a key. Signs of neighbouring places go together, so four places tell about 2 ** 24 sounds
#: apart, which many recordings share by chance; seven tell enough.
BANDS = ((0, 3, 8, 9, 12, 14, 15), (0, 2, 5, 8, 10, 12, 15), (0, 3, 5, 9, 10, 13, 15))
#: Bits of the prefilter for each key of the queries, and bits at most (64 MB).
KEY_BITS, MOST_BITS = 16, 1 << 29


def _filters() -> list[list[tuple[int, int, int, int, int]]]:
    """Sixteen filters: rectangles (time from, to, class from, to, sign) whose means are added or taken off."""
    out = []
    for k in range(16):
        low, high = (5 * k) % 12, (5 * k) % 12 + 3 + k % 3
        bands = [(low, min(12, high))] + ([(0, high - 12)] if high > 12 else [])
        width = (16, 8, 12, 4)[k % 4]
        start = (WINDOW - width) // 2
        half = width // 2
        parts = []
        for a, b in bands:
            if k % 2:  # earlier against later
                parts += [(start, start + half, a, b, 1), (start + half, start + width, a, b, -1)]
            else:  # these classes against the next ones
                parts += [(start, start + width, a, b, 1), (start, start + width, (a + 6) % 12, (a + 6) % 12 + min(b - a, 12 - (a + 6) % 12), -1)]
        out.append(parts)
    return out


FILTERS = _filters()


def _folding() -> np.ndarray:
    """Weights of each spectrum bin on each pitch class; bins between 100 and 1000 Hz, shared by the two nearest classes."""
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(bins), 12), np.float32)
    for k, f in enumerate(bins):
        if 100 <= f <= 1000:
            pitch = 12 * np.log2(f / 261.6256)
            low = int(np.floor(pitch))
            out[k, low % 12] += 1 - (pitch - low)
            out[k, (low + 1) % 12] += pitch - low
    return out


FOLDING = _folding()
HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Rows of twelve energies, one for each hop; the recording is filled up with silence to at least one window."""
    if not len(pcm):
        return np.zeros((0, 12), np.float32)
    frames = max(WINDOW, -(-max(0, len(pcm) - FRAME) // HOP) + 1)
    x = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    x[: len(pcm)] = pcm[: len(x)]
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((frames, 12), np.float32)
    for at in range(0, frames, 4096):
        spectrum = np.fft.rfft(view[at : at + 4096] * HANN, axis=1)
        out[at : at + 4096] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ FOLDING
    return out


def fingerprint_all(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """Packed integers of each recording, one for each place of the filter window; none for an empty recording."""
    images = [chroma(r) for r in recordings]
    if not any(len(i) for i in images):
        return [np.zeros(0, np.uint32) for _ in images]
    gap = len(SMOOTH) // 2
    # one image for all, with empty rows between recordings, so that smoothing does not mix them
    starts = np.cumsum([0, *(len(i) + gap for i in images)]) + gap
    n = int(starts[-1])
    image = np.zeros((n + gap, 12))
    for at, one in zip(starts, images, strict=False):
        image[at : at + len(one)] = one
    image[gap:n] = sum(w * image[k : n - gap + k] for k, w in enumerate(SMOOTH))
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    image = np.where(norm > 1e-6, image / np.maximum(norm, 1e-6), 0.0)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    places = len(image) - WINDOW + 1
    packed = np.zeros(places, np.uint32)
    for k, parts in enumerate(FILTERS):
        value = np.zeros(len(packed))
        for a, b, c, d, sign in parts:
            box = integral[b : b + places, d] - integral[a : a + places, d] - integral[b : b + places, c] + integral[a : a + places, c]
            value += sign * box / ((b - a) * (d - c))
        # prefix sums of other recordings leave rounding errors of 1e-12 or so; a coarse grid takes them away
        value = np.round(value, 7)
        level = (value > -THRESHOLD).astype(np.uint32) + (value > 0) + (value > THRESHOLD)
        packed |= (level ^ (level >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)
    return [packed[at : at + len(one) - WINDOW + 1].copy() if len(one) else np.zeros(0, np.uint32) for at, one in zip(starts, images, strict=False)]


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    return fingerprint_all([pcm])[0]


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE from samples at another rate: a low-pass filter, and values between samples by straight lines."""
    if rate == RATE or not len(x):
        return x
    half = 16 * max(1, -(-rate // RATE))
    at = np.arange(-half, half + 1)
    band = 0.9 * min(1.0, RATE / rate)
    kernel = (band * np.sinc(band * at) * np.hanning(2 * half + 3)[1:-1]).astype(np.float32)
    filled = np.concatenate([np.zeros(half, np.float32), x, np.zeros(half, np.float32)])
    smooth = np.convolve(filled, kernel, "valid")
    return np.interp(np.arange(int(len(x) * RATE / rate)) * (rate / RATE), np.arange(len(smooth)), smooth).astype(np.float32)


def pcm16(column: pa.Array, rate: int = RATE) -> list[np.ndarray]:
    """Samples of little-endian 16-bit mono audio at a rate; null is an empty recording."""
    return [resampled(np.frombuffer((d or b"")[: len(d or b"") // 2 * 2], "<i2").astype(np.float32) / 32768, rate) for d in column.to_pylist()]


def _of_wav(data: bytes | None) -> np.ndarray:
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    n = len(raw) // (width * channels)
    raw = raw[: n * width * channels]
    if width == 1:  # the only unsigned one
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    else:  # the highest two bytes of each sample
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, width)[:, -2:]).view("<i2").astype(np.float32).ravel() / 32768
    return resampled(x.reshape(n, channels).mean(1), rate)


def wav(column: pa.Array) -> list[np.ndarray]:
    """Samples of WAV files with whole-number samples of any width, rate and number of channels; what does not parse is an empty recording."""
    return [_of_wav(d) for d in column.to_pylist()]


def fingerprints(df: DataFrame, key: str, media: str, limit: int = 1 << 20, decode: Callable[[pa.Array], list[np.ndarray]] = pcm16) -> DataFrame:
    """id, k1, k2, fp (binary: packed 32-bit integers) of each row of df; (k1, k2) is a hash of fp. ``decode`` makes samples of a column's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", limit):
            prints = fingerprint_all(decode(batch.column(1)))
            keys = np.zeros((len(prints), 2), np.uint64)
            for i, p in enumerate(prints):
                v = mix64(p.astype(np.uint64) + (np.arange(len(p), dtype=np.uint64) << np.uint64(32)))
                keys[i] = v.sum(dtype=np.uint64), mix64(v ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(np.ascontiguousarray(keys[:, 0])), signed(np.ascontiguousarray(keys[:, 1])), pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary())], names=["id", "k1", "k2", "fp"])

    source = df.select(named(key).cast("long").alias("id"), named(media).alias("media"))
    return source.mapInArrow(run, "id long, k1 long, k2 long, fp binary")


def stretch(errors: np.ndarray, least: int = LEAST, most: float = ERROR) -> tuple[int, int, float] | None:
    """(first, length, share of wrong bits) of the longest stretch whose share is at most ``most``; None if it is under ``least``.

    The longest run with a mean at most ``most``: prefix sums of the excess, matched from both ends.
    """
    n = len(errors)
    if n < least:
        return None
    sums = np.concatenate([[0.0], np.cumsum(errors / 32.0 - most)])
    # a start is useful if no earlier prefix is as high; for an end take the earliest start at least as high
    high = np.maximum.accumulate(sums)
    starts = np.searchsorted(high, sums - 1e-12, side="left")
    lengths = np.arange(n + 1) - starts
    end = int(np.argmax(lengths))
    if lengths[end] < least:
        return None
    first = int(starts[end])
    return first, int(lengths[end]), float(errors[first:end].mean() / 32.0)


def landmarks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of a recording: for each band the signs of the sixteen filters at its places, where they differ from the place before.

    One integer alone meets by chance in many recordings; the signs at seven places hardly do, and
    survive small changes better than all of an integer's bits. A held sound votes once.
    """
    sign = np.zeros(len(p), np.uint64)
    for j in range(16):
        sign |= ((p.astype(np.uint64) >> np.uint64(2 * j + 1)) & np.uint64(1)) << np.uint64(j)
    keys, places = [], []
    for number, band in enumerate(BANDS):
        n = len(p) - max(band)
        if n <= 0:
            continue
        key = np.full(n, number + 1, np.uint64)
        for d in band:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sign[d : d + n])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[at])
        places.append(at)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(places)


class QueryBlock:
    """Fingerprints of a bounded number of queries, sorted by value."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        marks = [landmarks(p) for p in prints]
        values = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in marks)])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.query = np.repeat(np.arange(len(ids), dtype=np.int32), [len(k) for k, _ in marks])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(a for _, a in marks)])[order]

    def offsets(self, p: np.ndarray) -> dict[int, int]:
        """Query -> the offset (place in p less place in the query) with the most votes, the least of equals."""
        keys, marks = landmarks(p)
        low, high = np.searchsorted(self.values, keys), np.searchsorted(self.values, keys, side="right")
        n = high - low
        held = np.flatnonzero(n)
        if not len(held):
            return {}
        total = np.cumsum(n[held])
        codes, votes, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(held):  # distinct (query, offset) are kept, and never all votes
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + VOTES, side="right")))
            some = held[at:stop]
            m = n[some]
            inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[some], m)
            code, count = np.unique((self.query[inside].astype(np.int64) << 32) + (np.repeat(marks[some], m) - self.place[inside] + (1 << 31)), return_counts=True)
            if len(codes):
                both, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
                codes, votes = both, np.bincount(back, np.concatenate([votes, count])).astype(np.int64)
            else:
                codes, votes = code, count
            at = stop
        order = np.lexsort((codes, -votes, codes >> 32))
        first = np.unique(codes[order] >> 32, return_index=True)[1]
        return {int(c >> 32): int((c & 0xFFFFFFFF) - (1 << 31)) for c in codes[order][first]}

    def matches(self, p: np.ndarray, least: int = LEAST, most: float = ERROR) -> list[tuple[int, int, int, int, float]]:
        """(query, offset, first place in the query, length, share of wrong bits)."""
        out = []
        for q, offset in self.offsets(p).items():
            other = self.prints[q]
            a = max(0, -offset)
            b = min(len(other), len(p) - offset)
            if b - a >= least:
                got = stretch(np.bitwise_count(other[a:b] ^ p[a + offset : b + offset]), least, most)
                if got:
                    out.append((self.ids[q], offset, a + got[0], got[1], got[2]))
        return out


def _keys_of(marks=None, column: str = "block"):
    """(key, ``column``) of each recording (``column``, fp); with ``marks`` only keys that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "fp"):
            keys = [np.unique(landmarks(np.frombuffer(p, "<u4"))[0]) for p in batch.column(1).to_pylist()]
            owner = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            keys = np.concatenate([np.zeros(0, np.uint64), *keys])
            if marks is not None:
                hit = marked(marks.value, keys)
                keys, owner = keys[hit], owner[hit]
            yield pa.RecordBatch.from_arrays([signed(keys), pa.array(owner)], names=["key", column])

    return run


def _compare(least: int, most: float, schema: pa.Schema):
    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows and others.num_rows:
            asked = asked.sort_by("class_id")
            queries = QueryBlock(asked.column("class_id").to_pylist(), [np.frombuffer(x, "<u4") for x in asked.column("fp").to_pylist()])
            for c, p in zip(others.column("other").to_pylist(), others.column("other_fp"), strict=True):
                found += [(c, c, *m) for m in queries.matches(np.frombuffer(p.as_buffer(), "<u4"), least, most) if m[0] != c]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(schema)], schema=schema)

    return run


def align(prints: DataFrame, is_query: Column, least: int = LEAST, most: float = ERROR, block: int = BLOCK, tile: int = TILE, salt: int = SALT) -> DataFrame:
    """Search the recordings that meet ``is_query`` (a condition on ``id``) in all recordings.

    prints: id, k1, k2, fp of ``fingerprints``. Rows of two kinds: for each recording (doc_id, class_id) with nulls else, where
    class_id is the least id with the same fingerprints; and for each pair of a query class and another class that match, doc_id and
    class_id of that class, query_class, offset (places), first, length and error. A class is a query if one of its
    recordings is. A match is ``least`` places long or more, so shorter recordings match their equals only, as a class; empty
    recordings are one class. Rows with a null id are left out. An offset is looked at if it has the most equal keys of the pair: that
    finds all matches of twice ``least`` places in tests against all offsets; of shorter ones with nearly ``most`` wrong bits, many share no key.
    """
    rows = checkpoint(prints.where("id IS NOT NULL"))
    reps = checkpoint(rows.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asks"), F.first("fp").alias("fp")))
    members = rows.select("id", "k1", "k2").join(reps.select("k1", "k2", "class_id"), ["k1", "k2"]).select(F.col("id").alias("doc_id"), "class_id")
    out = members.select("doc_id", "class_id", *(F.lit(None).cast(t).alias(c) for c, t in (("query_class", "long"), ("offset", "long"), ("first", "long"), ("length", "long"), ("error", "double"))))
    sounding = reps.where("octet_length(fp) > 0")
    asked = sounding.where("asks")
    total = asked.agg(F.sum(F.floor(F.octet_length("fp") / 4)).alias("n")).first().n or 0
    if not total:
        return out
    blocks = int(-(-total // block))
    asked = asked.select("class_id", "fp", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"))

    # which classes share a key with which block
    wanted = checkpoint(asked.select("block", "fp").mapInArrow(_keys_of(), "key long, block long").distinct())
    bits = min(MOST_BITS, max(BITMAP_BITS, 1 << (KEY_BITS * wanted.count()).bit_length()))
    marks = prints.sparkSession.sparkContext.broadcast(bitmap(wanted, "key", bits))
    held = checkpoint(sounding.select("class_id", "fp").mapInArrow(_keys_of(marks, "class_id"), "key long, class_id long"))
    common = few_rows(checkpoint(held.groupBy("key").agg(F.ceil(F.count("*") / salt).cast("int").alias("salts")).where("salts > 1")))
    held = held.join(common, "key", "left").select("key", "class_id", F.pmod(F.xxhash64("class_id"), F.coalesce("salts", F.lit(1))).alias("salt"))
    wanted = wanted.join(common, "key", "left").select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    met = held.join(wanted, ["key", "salt"]).select("class_id", "block").distinct()

    # tiles: a block's queries and a bounded part of the classes that it meets
    others = checkpoint(met.join(sounding.select("class_id", "fp"), "class_id"))
    parts = others.groupBy("block").agg(F.ceil(F.sum(F.octet_length("fp")) / (4 * tile)).cast("long").alias("parts"))
    parts = few_rows(checkpoint(parts))
    left = asked.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "class_id", "fp")
    right = others.join(parts, "block").select("block", F.pmod(F.xxhash64("class_id", F.lit("part")), F.col("parts")).alias("part"), F.col("class_id").alias("other"), F.col("fp").alias("other_fp"))
    fields = [("doc_id", pa.int64()), ("class_id", pa.int64()), ("query_class", pa.int64()), ("offset", pa.int64()), ("first", pa.int64()), ("length", pa.int64()), ("error", pa.float64())]
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_compare(least, most, pa.schema(fields)), out.schema)
    return out.unionByName(found)
