"""Best inner products by 8-bit codes with bounds of their error; only what a bound cannot rule out is computed in double precision.

A vector x is kept as bytes c and a scale s, with e, the length of x - s * c, and its norm. For a vector x and a query q the product x . q differs from
s_x * s_q * (c_x . c_q) by (|x| + e_x) * e_q + e_x * |q| at most. A pass over the codes keeps, for each query and list, the k-th largest lower
bound that a task has seen, and drops what has an upper bound under it; the tasks' rows meet in one more such cut over all. What is left is
written and, if it is small, broadcast to the vectors, which are then not shuffled. Codes take an eighth of the bytes of doubles, and their products are matrix products of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import kept
from . import rank
from .score import MOST_NARROW, dot, small

#: Components of the queries of a block; rows of a product; candidates that a task holds before it cuts them.
BLOCK_VALUES, ROWS, HELD = 1 << 21, 1024, 1 << 21
#: Components whose products of two bytes sum to less than 2 ** 24, exactly in single precision.
EXACT = (1 << 24) // (127 * 127)
#: Scores are rounded to six places, so what is nearer than this may change places.
ROOM = 2e-6
COLUMNS = ("code", "code_scale", "code_error", "code_norm")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, length of the error, norm) of rows x; a zero row is all zeros."""
    most = np.abs(x).max(axis=1, initial=0.0)
    scale = most / 127
    q = np.rint(np.divide(x, scale[:, None], out=np.zeros_like(x), where=scale[:, None] > 0))
    error = np.linalg.norm(x - scale[:, None] * q, axis=1)
    norm = np.linalg.norm(x, axis=1)
    return q.astype(np.int8), scale, error + 1e-14 * x.shape[1] * norm, norm


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no component null or not finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def coded(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with the codes of its vectors; rows whose vector takes no part are left out."""
    given = [f for f in df.schema.fields if f.name != vector]
    out = T.StructType([*given, T.StructField(vector, T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in COLUMNS[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            codes, numbers = np.empty(len(sizes), object), np.zeros((3, len(sizes)))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                q, *rest = quantised(np.array(vectors.take(pa.array(at)).flatten()).reshape(len(at), -1))
                codes[at] = [row.tobytes() for row in q]
                numbers[:, at] = rest
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.binary()), *(pa.array(n) for n in numbers)], names=out.names)

    slim = df.where(usable(F.col(vector))).select(*(f.name for f in given), F.col(vector).cast("array<double>").alias(vector))
    return slim.mapInArrow(run, out)


def write(df: DataFrame, path: str, vector: str = "embedding") -> DataFrame:
    """Write df with its codes and return what was written: a scan of the codes leaves the vectors' pages unread."""
    coded(df, vector).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of queries (query_id, vector) of one length, in blocks of bounded size, read one after another."""
    held: dict[int, tuple[list, list]] = {}
    for r in queries.where(usable(F.col("vector"))).select("query_id", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator():
        ids, vectors = held.setdefault(len(r.vector), ([], []))
        ids.append(r.query_id)
        vectors.append(r.vector)
        if len(ids) * len(r.vector) >= BLOCK_VALUES:
            yield ids, np.array(held.pop(len(r.vector))[1])
    for ids, vectors in held.values():
        yield ids, np.array(vectors)


class Best:
    """The k largest lower bounds of each query in one list, and the rows that may still be among its k best."""

    def __init__(self, n: int, k: int):
        self.k, self.lower = k, np.full((n, k), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def floor(self) -> np.ndarray:
        return self.lower[:, 0] - ROOM

    def add(self, first: int, scores: np.ndarray, bounds: np.ndarray) -> None:
        """scores and bounds of (queries, rows); rows are numbered from ``first``."""
        low = scores - bounds
        both = np.concatenate([self.lower, low], axis=1)
        self.lower = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        q, r = np.nonzero(scores + bounds >= self.floor()[:, None])
        self.parts.append((q, r + first, (scores + bounds)[q, r], low[q, r]))
        self.size += len(q)

    def cut(self) -> tuple[np.ndarray, ...]:
        q, r, high, low = (np.concatenate([p[i] for p in self.parts]) for i in range(4)) if self.parts else (np.zeros(0, int),) * 2 + (np.zeros(0),) * 2
        keep = high >= self.floor()[q]
        self.parts = [(q[keep], r[keep], high[keep], low[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _candidates(block, k: int):
    """place, list, row, high, low: what may be among the k best of each query of the block in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_q, s_q, e_q, n_q = block.value
        side = c_q.astype(np.float32).T
        best: dict[object, Best] = {}
        rows: list[object] = []

        def out(name: object, found: Best) -> pa.RecordBatch:
            q, r, high, low = found.cut()
            found.parts, found.size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([name] * len(q), pa.string()), pa.array([rows[i] for i in r.tolist()], pa.string()), pa.array(high), pa.array(low)], names=["place", "list", "row", "high", "low"])

        for batch in batches:
            fits = pc.equal(pc.binary_length(batch.column("code")), c_q.shape[1])
            batch = batch.filter(fits)
            names = batch.column("list").dictionary_encode()
            owners = names.indices.to_numpy(zero_copy_only=False)
            for number, name in enumerate(names.dictionary.to_pylist()):
                at = np.flatnonzero(owners == number)
                for start in range(0, len(at), ROWS):
                    part = batch.take(pa.array(at[start : start + ROWS]))
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
                    sums = sum((codes[:, i : i + EXACT].astype(np.float32) @ side[i : i + EXACT]).astype(np.float64) for i in range(0, codes.shape[1], EXACT))
                    scale, error, norm = (part.column(c).to_numpy() for c in COLUMNS[1:])
                    bounds = (norm + error)[None, :] * e_q[:, None] + error[None, :] * n_q[:, None]
                    found = best.setdefault(name, Best(len(s_q), k))
                    found.add(len(rows), sums.T * scale[None, :] * s_q[:, None], bounds)
                    rows.extend(part.column("row").to_pylist())
                    if found.size > HELD:
                        found.cut()
                        if found.size > HELD // 2:  # too many that no bound tells apart: hand them on
                            yield out(name, found)
        for name, found in best.items():
            yield out(name, found)

    return run


def candidates(chunks: DataFrame, queries: DataFrame, k: int, by: str = "collection", key: str = "chunk_id") -> DataFrame:
    """query_id, by, key: what may be among the k largest products of each query (query_id, vector) with the coded chunks of each list; keys are strings."""
    spark, out = chunks.sparkSession, None
    slim = chunks.select(F.col(by).alias("list"), F.col(key).alias("row"), *COLUMNS)
    kind = queries.schema["query_id"].dataType
    for ids, vectors in _blocks(queries):
        block = spark.sparkContext.broadcast(quantised(vectors))
        found = slim.mapInArrow(_candidates(block, k), "place int, list string, row string, high double, low double")
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("query_id", kind)]))
        kth = rank.top(found, ["place", "list"], [F.col("low").desc()], k, "n").where(F.col("n") == k).select("place", "list", F.col("low").alias("_kth"))
        near = found.join(small(kth), ["place", "list"], "left").where(F.col("_kth").isNull() | (F.col("high") >= F.col("_kth") - ROOM))
        part = near.join(F.broadcast(names), "place").select("query_id", F.col("list").alias(by), F.col("row").alias(key))
        out = part if out is None else out.unionByName(part)
    if out is None:
        fields = [T.StructField("query_id", kind), T.StructField(by, T.StringType()), T.StructField(key, T.StringType())]
        return spark.createDataFrame([], T.StructType(fields))
    return out


def best(chunks: DataFrame, queries: DataFrame, k: int, places: int = 6, by: str = "collection", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The chunks that may be among the k best of each query in each list, with query_id and score: their products in double precision, rounded.

    chunks: coded ones, or such that have vectors only, which are coded on the way. Vectors that are null or hold null or non-finite components take
    no part, and those of another length than the query's are not compared.
    """
    chunks = chunks if set(COLUMNS) <= set(chunks.columns) else coded(chunks, vector)
    near = small(kept(candidates(chunks, queries, k, by, key)), MOST_NARROW)
    scored = chunks.drop(*COLUMNS).join(near, [by, key]).join(small(queries.select("query_id", "vector")), "query_id")
    return scored.withColumn("score", F.round(dot(F.col(vector), F.col("vector")), places)).drop("vector")
