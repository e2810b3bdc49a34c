"""Helpers shared by the operators: batch slicing, word hashing, keys, bounded bitmaps, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python step handles at once; bounds its working memory.
SLICE_BYTES = 2 << 20
#: Bits of the prefilter bitmaps; fixed, so what is broadcast (8 MB) never grows with the data.
BITMAP_BITS = 1 << 26


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the session names.

    spark.checkpoint.dir is read from the session; only where it is unset on a local master (tests) a local folder
    is made, as executors of a cluster would not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one on a local master, and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint_")


def few_rows(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it has ``most`` rows or fewer; else as it is, so that joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def named(name: str) -> Column:
    """The column of exactly this name, dots and other marks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name, dots included: rows go to the workers and come back under plain names."""
    names = df.columns
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(out.fields)])

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain.names)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(wrapped, plain).toDF(*out.names)


def give_back() -> None:
    """Return freed memory to the system, which the allocators of a worker that lives on would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS = np.cumprod(np.full(1 << 12, 0x5851F42D4C957F2D | 1, dtype=np.uint64), dtype=np.uint64)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same in every run and process."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(strings), dtype=np.uint64)
    if not len(strings):
        return out
    lengths = np.diff(offsets)
    small = lengths <= len(_POWERS)
    size = int(offsets[-1] - offsets[0])
    if size:
        place = np.arange(size, dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], lengths)
        terms = (raw[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)]
        if not small.all():  # later windows of a long string are mixed with their number
            terms = mix64(terms + (place // len(_POWERS)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        full = lengths > 0
        out[full] = np.add.reduceat(terms, (offsets[:-1] - offsets[0])[full])
    return mix64(out ^ (lengths.astype(np.uint64) << np.uint64(48)))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words are runs without ASCII white space, null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    flat = words.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    parent = pc.list_parent_indices(words).filter(keep).to_numpy(zero_copy_only=False)
    counts = np.bincount(parent, minlength=len(texts)).astype(np.int64)
    codes = flat.filter(keep).dictionary_encode()
    return string_hashes(codes.dictionary)[codes.indices.to_numpy(zero_copy_only=False)], counts


def runs_of(hashes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``length`` words, number of runs of each text); a shorter text is one run, an empty text none."""
    n = np.where(counts >= length, counts - length + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), n
    inside = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(starts, n) + inside
    left = np.repeat(counts, n) - inside
    out = np.zeros(total, np.uint64)
    factor = np.uint64(0xD1342543DE82EF95)
    last = len(hashes) - 1
    for k in range(length):
        word = hashes[np.minimum(at + k, last)]
        out = out * factor + np.where(k < left, word, np.uint64(k + 1))
    return mix64(out), n


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Marks of a 64-bit column, ``bits`` of them, made by a distributed bit_or; at most bits / 64 rows reach the driver.

    A mark says "perhaps": callers join exactly afterwards. With more keys than bits every mark
    is set and the prefilter lets all pass, which is slower and still right.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    rows = (
        hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have a mark."""
    bits = np.uint64(len(marks) * 64)
    place = hashes.view(np.uint64) % bits  # the same as pmod for powers of two
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def text_key(text: Column) -> Column:
    """A 128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
