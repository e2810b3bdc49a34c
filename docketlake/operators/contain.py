"""Which documents hold which passages, by rolling hashes of a few window lengths.

A passage of n bytes is known by the hashes of its first and of its last w bytes, where w is the largest power of two not above n, so both together cover it. A
document gives, for each such w that some passage has, the places whose window hashes like a passage's start, told by a bitmap of
fixed size; the place's next 2 * w bytes go along, join the passages on the hash, and are compared byte by byte. So no pair of document and passage is
formed that does not agree on half of the passage at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the bitmap of window hashes (8 MB), and text bytes of a slice.
BITS, SLICE = 1 << 26, 4 << 20
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Rolling:
    """Hashes of all windows of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        terms = (raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n)

    def windows(self, width: int) -> np.ndarray:
        if self.n < width:
            return np.zeros(0, np.uint64)
        h = (self.sums[width:] - self.sums[:-width]) * self.back[: self.n - width + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32)) ^ np.uint64(width)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number, width, hash of each passage's first bytes."""
    for batch in batches:
        numbers, widths, hashes = [], [], []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            if raw:
                width = 1 << (len(raw).bit_length() - 1)
                numbers.append(number)
                widths.append(width)
                hashes.append(int(Rolling(np.frombuffer(raw[:width], np.uint8)).windows(width)[0].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(widths, pa.int32()), pa.array(hashes, pa.int64())], names=["number", "width", "hash"])


def _marks(starts: DataFrame) -> np.ndarray:
    """A bitmap of the hashes, made by a distributed bit_or: BITS / 64 numbers at most reach the driver, whatever the number of passages."""
    place = F.pmod("hash", F.lit(BITS))
    rows = starts.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def _places(marks, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            keys, out = batch.column(0), ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                rolling = Rolling(np.frombuffer(raw, np.uint8))
                for width in widths:
                    hashes = rolling.windows(width)
                    at = hashes % np.uint64(BITS)
                    hit = np.flatnonzero((marks.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                    # what may follow is compared later; a document tells each such stretch once
                    for stretch, h in {raw[p : p + 2 * width]: h for p, h in zip(hit.tolist(), hashes[hit].view(np.int64).tolist(), strict=True)}.items():
                        for column, value in zip(out, (i, width, h, stretch), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["key", "width", "hash", "stretch"])

    return run


def containing(docs: DataFrame, passages: DataFrame, key: str, text: str, passage: str) -> DataFrame:
    """The columns of passages but ``passage``, and ``key``: once each document (key, text) that holds each passage. Null and empty texts and passages are in nothing."""
    others = [c for c in passages.columns if c != passage]
    numbered = passages.select(F.struct(*others).alias("own"), F.col(passage).cast("string").alias("passage"), F.monotonically_increasing_id().alias("number"))
    starts = numbered.select("number", "passage").mapInArrow(_starts, "number long, width int, hash long")
    widths = sorted(r.width for r in starts.select("width").distinct().collect())  # powers of two: 31 at most
    marks = docs.sparkSession.sparkContext.broadcast(_marks(starts))
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("width", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("stretch", T.BinaryType())])
    places = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(_places(marks, widths), out)
    asked = starts.join(numbered, "number").select("width", "hash", "own", F.col("passage").cast("binary").alias("bytes"))
    met = places.join(asked, ["width", "hash"]).where(F.expr("startswith(stretch, bytes)"))
    return met.select("own", "key").distinct().select(*(F.col("own")[c].alias(c) for c in others), F.col("key").alias(key))
