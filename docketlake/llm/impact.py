"""Ranked lexical search, score at a time over impact-ordered postings.

Terms are runs of ASCII digits and letters and of all characters beyond ASCII; only A-Z is lower-cased. All scores are integers.

* One pass over the documents counts the terms of the batch in each; the counts are written, and give the documents of each term.
* The written documents are searched in slices. The postings of a slice are grouped by term and exact impact, from the highest impact
  down. For an item the groups of its terms are added to accumulators in descending order of what they add. It ends when the sum of
  what the next group of each term adds, the most that a document not met yet can reach, is under the k-th best score found so
  far, in this slice or in earlier ones of the task. Documents met that cannot reach it either are dropped, the others' scores
  are completed from all their terms.
* The best of each task are merged. So postings are never shuffled, and a task holds one slice and k rows for each item.

Items are taken in batches of bounded numbers of terms; what is broadcast is a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint, named, slices
from ._tokens import byte_runs

K = 20
#: Terms, repeats of an item left out, of the items of a batch; and items of a batch.
BATCH_TERMS, BATCH_ITEMS = 400_000, 4_000
#: Postings of a slice.
POSTINGS = 1 << 21
#: Each step of the search takes the groups that add this share of the step before, or more.
STEP = 0.8
#: Impacts are less than 2 ** 20.
IMPACT_BITS = 20

_MEMBER = np.zeros(256, bool)
_MEMBER[48:58] = _MEMBER[65:91] = _MEMBER[97:123] = True
_MEMBER[128:] = True


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts as bytes, number of terms of each text)."""
    return byte_runs(texts, lambda raw: _MEMBER[raw])


def weight(n_documents: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n_holding + 1)))


def middle(n_terms: np.ndarray, n_documents: int, all_terms: int) -> np.ndarray:
    """What a document's length makes of 12 counts of a term."""
    return 100 - 25 + (25 * n_terms * n_documents) // max(1, all_terms)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Batch:
    """The terms of some items: the vocabulary, and for each item its terms' places in it and how often it has each."""

    def __init__(self, items: list[tuple[int | None, list[bytes], list[int]]]):
        self.names = [item for item, _, _ in items]
        self.vocabulary = sorted({t for _, own, _ in items for t in own})
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.codes = [np.array([place[t] for t in own], np.int64) for _, own, _ in items]
        self.times = [np.array(n, np.int64) for _, _, n in items]


def _item_terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows, "text"):
        found, counts = terms(batch.column(1))
        ends = np.cumsum(counts)
        own, times = [], []
        for e, c in zip(ends.tolist(), counts.tolist(), strict=True):
            each = pc.value_counts(found[e - c : e])
            own.append(each.field("values").to_pylist())
            times.append(each.field("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names=["item", "terms", "times"])


def _batches(items: DataFrame, most_terms: int, most_items: int) -> Iterator[Batch]:
    """Batches of items, read one after another; an item without terms is in none."""
    held: list[tuple[int | None, list[bytes], list[int]]] = []
    size = 0
    for r in items.mapInArrow(_item_terms, "item long, terms array<binary>, times array<long>").toLocalIterator():
        if r.terms:
            if held and (size + len(r.terms) > most_terms or len(held) == most_items):
                yield Batch(held)
                held, size = [], 0
            held.append((r.item, [bytes(t) for t in r.terms], r.times))
            size += len(r.terms)
    if held:
        yield Batch(held)


def _counted(vocabulary):
    """id, n, codes, tfs: the number of terms of each document that has any, and the counts of those of the vocabulary."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_binary())
        width = np.uint16 if len(known) <= 1 << 16 else np.uint32
        for batch in slices(rows, "text"):
            found, n = terms(batch.column(1))
            codes = pc.index_in(found, known)
            parents = np.repeat(np.arange(len(n)), n)[pc.is_valid(codes).to_numpy(zero_copy_only=False)]
            pairs, tf = np.unique(parents * len(known) + codes.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(pairs // len(known), np.arange(len(n) + 1))
            packed = (pairs % len(known)).astype(width)
            some = np.flatnonzero(n)
            lists = []
            for i in some.tolist():
                own = tf[ends[i] : ends[i + 1]]
                lists.append((packed[ends[i] : ends[i + 1]].tobytes(), own.astype(np.min_scalar_type(int(own.max()))).tobytes() if len(own) else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some]), pa.array([x[0] for x in lists], pa.binary()), pa.array([x[1] for x in lists], pa.binary())], names=["id", "n", "codes", "tfs"])

    return run


def _unpacked(rows: pa.RecordBatch | pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, number of postings of each document) of a vocabulary of ``size``."""
    width = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
    blobs, counts = rows.column("codes").to_pylist(), rows.column("tfs").to_pylist()
    each = np.array([len(b) // width.itemsize for b in blobs], np.int64)
    codes = np.frombuffer(b"".join(blobs), width).astype(np.int64)
    parts = [np.frombuffer(t, f"u{len(t) // k}").astype(np.int64) for t, k in zip(counts, each.tolist(), strict=True) if k]
    return codes, np.concatenate(parts) if parts else np.zeros(0, np.int64), each


def _sums(size: int):
    """code, n: documents that hold each term; -1 counts the documents and -2 all their terms."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, total = np.zeros(size, np.int64), 0, 0
        for batch in rows:
            holding += np.bincount(_unpacked(batch, size)[0], minlength=size)
            documents += batch.num_rows
            total += int(pc.sum(batch.column("n")).as_py() or 0)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([holding[some], [documents, total]]))], names=["code", "n"])

    return run


class Slice:
    """Documents with their postings, by document and by term and descending impact."""

    def __init__(self, ids: pa.Array, n: np.ndarray, codes: np.ndarray, tf: np.ndarray, each: np.ndarray, n_documents: int, all_terms: int):
        self.ids, self.size = ids, len(n)
        self.ends = np.cumsum(each)
        self.starts = self.ends - each
        owner = np.repeat(np.arange(len(n)), each)
        self.codes, self.impacts = codes, impact(tf, middle(n, n_documents, all_terms)[owner])
        keys = (codes << IMPACT_BITS) | ((1 << IMPACT_BITS) - 1 - self.impacts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.docs = keys[order], owner[order]  # groups of one key are the postings of one term and impact

    def _next(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The impact of the next group of each term, 0 where there is none."""
        key = self.keys[np.minimum(at, len(self.keys) - 1)] if len(self.keys) else np.full(len(at), -1)
        fits = (at < len(self.keys)) & (key >> IMPACT_BITS == codes)
        return np.where(fits, (1 << IMPACT_BITS) - 1 - (key & ((1 << IMPACT_BITS) - 1)), 0)

    def best(self, codes: np.ndarray, factors: np.ndarray, k: int, floor: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, whole scores) among which are all of the k best of the slice whose score is ``floor`` (1 at least) or more.

        factors: what an impact of each term counts; dense: a table of zeros for the vocabulary, given back so.
        """
        at = np.searchsorted(self.keys, codes << IMPACT_BITS)
        adds = factors * self._next(at, codes)
        met = np.zeros(self.size, np.int64)
        rest, level = int(adds.sum()), int(adds.max(initial=0))
        # a document not met can still reach the floor, or more than a few that were met can
        while rest >= floor or (rest and int(np.count_nonzero(met + rest >= floor)) > 4 * k):
            level = max(1, int(level * STEP))
            least = np.minimum(-(-level // factors), (1 << IMPACT_BITS) - 1)
            upto = np.maximum(at, np.searchsorted(self.keys, (codes << IMPACT_BITS) | ((1 << IMPACT_BITS) - 1 - least), side="right"))
            taken = upto - at
            if taken.any():
                index = np.repeat(at - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
                np.add.at(met, self.docs[index], np.repeat(factors, taken) * ((1 << IMPACT_BITS) - 1 - (self.keys[index] & ((1 << IMPACT_BITS) - 1))))
                at = upto
                adds = factors * self._next(at, codes)
                rest = int(adds.sum())
                if self.size >= k:
                    floor = max(floor, int(np.partition(met, -k)[-k]))
            level = min(level, int(adds.max(initial=0)))
        docs = np.flatnonzero(met + rest >= floor)
        docs = docs[met[docs] > 0]
        if rest:  # complete the scores from all terms
            each = self.ends[docs] - self.starts[docs]
            own = np.repeat(self.starts[docs] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            dense[codes] = factors
            met[docs] = 0
            np.add.at(met, np.repeat(docs, each), dense[self.codes[own]] * self.impacts[own])
            dense[codes] = 0
        return docs, met[docs]


def _search(batch, weights, k: int, n_documents: int, all_terms: int, postings: int):
    """item place, id, score: the k best of each item among the documents of a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heavy = batch.value, weights.value
        items = [(c[heavy[c] > 0], (t * heavy[c])[heavy[c] > 0]) for c, t in zip(asked.codes, asked.times, strict=True)]
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, no id, id), sorted
        dense = np.zeros(len(heavy), np.int64)
        for held in _gathered(rows, postings, len(heavy)):
            ids = held.ids.to_pylist()
            for i, (codes, factors) in enumerate(items):
                floor = -best[i][-1][0] if len(best[i]) == k else 1
                docs, scores = held.best(codes, factors, k, max(1, floor), dense)
                new = [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s >= max(1, floor)]
                if new:
                    best[i] = sorted(best[i] + new)[:k]
        found = [(i, None if none else key, -s) for i, rows_ in enumerate(best) for s, none, key in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["place", "id", "score"])

    def _gathered(rows: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[Slice]:
        """Rows as slices of about ``most`` postings; a batch that has more is cut between documents."""
        held, many = [], 0
        for b in rows:
            codes, tf, each = _unpacked(b, size)
            ends, start, n = np.cumsum(each), 0, b.column("n").to_numpy()
            while start < b.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + most - many, side="right")))
                upto = int(ends[stop - 1])
                held.append((b.column("id").slice(start, stop - start), n[start:stop], codes[before:upto], tf[before:upto], each[start:stop]))
                many += upto - before
                start = stop
                if many >= most or start < b.num_rows:
                    yield _joined(held)
                    held, many = [], 0
        if held:
            yield _joined(held)

    def _joined(held: list[tuple]) -> Slice:
        return Slice(pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[j] for h in held]) for j in range(1, 5)), n_documents, all_terms)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", batch_terms: int = BATCH_TERMS, batch_items: int = BATCH_ITEMS, postings: int = POSTINGS) -> DataFrame:
    """item, rank, key, score: the k best documents with a score above 0 of each item; equal scores by ascending key, null keys last.

    A document's score sums, over the item's terms with repeats, weight(term) * impact(count in the document). Every row of docs is a
    document and every row of items an item, repeated keys too. Null and empty texts have no terms: such documents are found by
    no item and counted nowhere, such items have no rows. Keys are integers.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    slim = docs.select(named(key).cast("long").alias("id"), named(text).cast("string").alias("text"))
    out = None
    for batch in _batches(items.select(named(item).cast("long").alias("item"), named(query).cast("string").alias("text")), batch_terms, batch_items):
        held = checkpoint(slim.mapInArrow(_counted(context.broadcast(batch.vocabulary)), "id long, n long, codes binary, tfs binary"))
        size = len(batch.vocabulary)
        sums = {r.code: r.n for r in held.mapInArrow(_sums(size), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}  # one row for each term of the batch
        n_documents, all_terms = sums.get(-1, 0), sums.get(-2, 0)
        weights = context.broadcast(np.array([weight(n_documents, sums[c]) if c in sums else 0 for c in range(size)], np.int64))
        found = held.mapInArrow(_search(context.broadcast(batch), weights, k, n_documents, all_terms, postings), "place int, id long, score long")
        order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(batch.names)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("item", T.LongType())]))
        ranked = checkpoint(ranked.join(F.broadcast(names), "place").select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"))
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        fields = [T.StructField(item, T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    return out
