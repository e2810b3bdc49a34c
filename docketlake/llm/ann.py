"""Approximate nearest neighbours by cosine over balanced posting lists.

* Equal vectors are one entry, which keeps its smallest ids, as no answer can hold more of them.
* Centroids come from a bounded sample, halved again and again at the median between two means, so
  that all lists are of one size there. All vectors are indexed. Vectors of each length have centroids of their own.
* A vector joins its nearest list and, near a boundary, others whose distance is within a ratio of the nearest,
  unless a chosen centroid lies nearer to that centroid than the vector does. Centroids are found by a best-first search of an in-memory
  neighbour graph, for a batch of vectors at a time.
* Where a table is so large that lists outgrow ``split`` vectors, a second level of centroids, fitted to a bounded sample of each such
  list, divides it by the same rules; the second level is a distributed table.
* A query reads the lists within a distance ratio of its nearest. Lists and their queries meet in tiles of bounded
  size; each tile keeps what can still be among the nearest, with the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, named


@dataclass(frozen=True)
class Settings:
    """Parameters of the index and of the search."""

    list_size: int = 128  # vectors of a list, in the mean
    max_lists: int = 4096
    sample: int = 20_000  # vectors that the fit collects, and ...
    sample_values: int = 4_000_000  # ... their components at most
    degree: int = 24  # neighbours of a centroid in the graph
    beam: int = 96  # entries of the search; also the most lists a query reads
    replicas: int = 6  # lists of a vector at most
    index_ratio: float = 1.25
    search_ratio: float = 1.6
    tile: int = 2048  # vectors, and queries, of a tile
    split: int = 1024  # vectors of a list from which it gets a second level, ...
    max_parts: int = 1024  # ... of so many parts at most, ...
    part_sample: int = 8192  # ... fitted to about so many of its vectors
    chunk: int = 20_000  # vectors, or queries, of a list that one task deals to parts


class Graph:
    """Unit centroids with edges to their nearest and to a few far ones; best-first search in lockstep."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        degree = min(degree, n - 1)
        near = np.full((n, 0), -1, np.int64)
        if degree > 0:
            rows = [self._spread(np.arange(at, min(n, at + 256)), degree) for at in range(0, n, 256)]
            near = np.concatenate(rows)
            # the way back, for as many as there is room
            a, b = np.repeat(np.arange(n), degree), near.reshape(-1)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            place = np.arange(len(b)) - np.searchsorted(b, b)
            fits = (place < degree) & (b >= 0)
            back = np.full((n, degree), -1, np.int64)
            back[b[fits], place[fits]] = a[fits]
            far = np.random.Generator(np.random.PCG64(7)).integers(0, n, size=(n, min(4, n)))
            near = np.concatenate([near, back, far], axis=1)
        self.edges = near
        self.seeds = np.arange(0, n, max(1, n // 64))

    def _spread(self, nodes: np.ndarray, degree: int) -> np.ndarray:
        """Up to ``degree`` neighbours of each node: the nearest, without those that lie nearer to one that is chosen than to the node; then the nearest of the rest."""
        n = len(self.c)
        dots = self.c[nodes] @ self.c.T
        dots[np.arange(len(nodes)), nodes] = -np.inf
        m = min(3 * degree, n - 1)
        ids = np.argpartition(-dots, m - 1, axis=1)[:, :m]
        ids = np.take_along_axis(ids, np.argsort(-np.take_along_axis(dots, ids, 1), axis=1, kind="stable"), 1)
        to_node = np.take_along_axis(dots, ids, 1)
        among = np.einsum("imd,ikd->imk", self.c[ids], self.c[ids])
        chosen = np.zeros(ids.shape, bool)
        for k in range(m):
            chosen[:, k] = ~((among[:, k, :] > to_node[:, k, None]) & chosen).any(axis=1) & (chosen.sum(1) < degree)
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :degree]
        return np.take_along_axis(ids, order, 1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of each row of unit vectors, nearest first, up to ``beam`` of them."""
        x = x.astype(np.float32)
        n, b = len(self.c), len(x)
        beam = min(beam, n)
        if n <= 2 * beam:  # the beam would hold most of them
            scores = x @ self.c.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
            return best, np.take_along_axis(scores, best, 1)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        seen[:, self.seeds] = True
        ids = np.broadcast_to(self.seeds, (b, len(self.seeds))).copy()
        scores = x @ self.c[self.seeds].T
        open_ = np.ones(ids.shape, bool)
        while True:
            order = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
            ids, scores, open_ = ids[rows, order], scores[rows, order], open_[rows, order]
            live = np.flatnonzero(open_.any(axis=1) & (scores[:, -1] >= -np.inf))
            if not len(live):
                return ids, scores
            pick = np.argmax(open_[live], axis=1)  # sorted: the first open entry is the nearest
            node = ids[live, pick]
            open_[live, pick] = False
            new = np.full((b, self.edges.shape[1]), -1, np.int64)
            new[live] = self.edges[node]
            fresh = (new >= 0) & ~seen[rows, np.maximum(new, 0)]
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            dots = np.full(new.shape, -np.inf, np.float32)
            at = np.nonzero(fresh)
            dots[at] = np.einsum("ij,ij->i", x[at[0]], self.c[new[at]])
            # an edge list may name a centroid twice
            ids, scores, open_ = np.concatenate([ids, np.maximum(new, 0)], 1), np.concatenate([scores, dots], 1), np.concatenate([open_, fresh], 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: cosines keep their bits, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Unit means of ``lists`` (a power of two) parts of equal size."""
    rng = np.random.Generator(np.random.PCG64(11))
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        halves = []
        for part in parts:
            if len(part) < 2:
                halves += [part]
                continue
            y = x[part]
            a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
            for _ in range(rounds):
                lean = y @ (a - b)
                left = np.argsort(-lean, kind="stable")[: len(y) // 2]
                mask = np.zeros(len(y), bool)
                mask[left] = True
                a, b = y[mask].mean(0), y[~mask].mean(0)
            halves += [part[mask], part[~mask]]
        if len(halves) == len(parts):
            break
        parts = halves
    means = np.array([x[p].mean(0) for p in parts])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(norms > 1e-12, means / np.maximum(norms, 1e-12), x[[p[0] for p in parts]])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def _stable_cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, by sums in one fixed order, so that a pair gives the same bits everywhere."""
    dot, qq, vv = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for k in range(q.shape[1]):
        dot += q[:, k] * v[:, k]
        qq += q[:, k] * q[:, k]
        vv += v[:, k] * v[:, k]
    return dot / (np.sqrt(qq) * np.sqrt(vv))


def _chosen(ids: np.ndarray, cos: np.ndarray, centroids: np.ndarray, settings: Settings, searching: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which of the found centroids, nearest first, a vector joins or a query reads; their distances)."""
    d = np.sqrt(np.maximum(0.0, 2 - 2 * cos.astype(np.float64)))
    d[~np.isfinite(cos)] = np.inf
    if searching:
        return d <= settings.search_ratio * d[:, :1] + 1e-9, d
    keep = np.zeros(d.shape, bool)
    keep[:, 0] = True
    for k in range(1, d.shape[1]):
        fits = (d[:, k] <= settings.index_ratio * d[:, 0] + 1e-9) & (keep.sum(1) < settings.replicas)
        for j in range(k):  # a chosen centroid that lies nearer to this one stands for it
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", centroids[ids[:, j]], centroids[ids[:, k]])))
            fits &= ~(keep[:, j] & (apart < d[:, k]))
        keep[:, k] = fits
    return keep, d


def _most(settings: Settings, searching: bool) -> int:
    return settings.beam if searching else 4 * settings.replicas


def _lists_of(graphs, settings: Settings, searching: bool):
    """Rows (dim, list, part, d, ...) of rows (dim, vec, ...): the lists of each vector; lengths without a graph have one list."""

    def dealt(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        graph = graphs.value.get(dim)
        if graph is None:
            rows, lists, d = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        else:
            x = _unit(_matrix(batch.column(batch.schema.get_field_index("vec"))).astype(np.float64))
            ids, cos = graph.search(x, _most(settings, searching))
            keep, far = _chosen(ids, cos, graph.c, settings, searching)
            rows, places = np.nonzero(keep)
            lists, d = ids[rows, places], far[rows, places]
        some = batch.take(pa.array(rows))
        arrays = [some.column("dim"), pa.array(lists.astype(np.int32)), pa.array(np.zeros(len(rows), np.int32)), pa.array(d), *some.columns[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=["dim", "list", "part", "d", *batch.schema.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = batch.column(0).to_numpy()
                for dim in np.unique(dims):
                    yield dealt(batch.filter(pa.array(dims == dim)), int(dim))

    return run


def _fit_parts(settings: Settings):
    """Unit centroids (dim, list, part, c) of a sample of one list's vectors (with the list's size n)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("q").combine_chunks()
        x = _unit(_matrix(table.column("vec").combine_chunks()).astype(np.float64))
        parts, n = 1, table.column("n")[0].as_py()
        while parts * 2 * settings.list_size <= n and parts * 2 <= min(settings.max_parts, len(x)):
            parts *= 2
        c = balanced_centroids(x, parts)
        same = lambda name: pa.array(np.full(len(c), table.column(name)[0].as_py(), np.int32))
        return pa.table({"dim": same("dim"), "list": same("list"), "part": pa.array(np.arange(len(c), dtype=np.int32)), "c": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))})

    return run


def _deal_parts(settings: Settings, searching: bool, names: list[str]):
    """Rows of a chunk of one list at the parts that they join or read."""

    def run(rows: pa.Table, parts: pa.Table) -> pa.Table:
        rows = rows.select(names).combine_chunks()
        if not rows.num_rows or not parts.num_rows:
            return rows.slice(0, 0)
        c = _matrix(parts.sort_by("part").column("c").combine_chunks()).astype(np.float32)
        out = []
        for at in range(0, rows.num_rows, 1024):
            some = rows.slice(at, 1024)
            scores = _unit(_matrix(some.column("vec").combine_chunks()).astype(np.float64)).astype(np.float32) @ c.T
            ids = np.argsort(-scores, axis=1, kind="stable")[:, : _most(settings, searching)]
            keep, far = _chosen(ids, np.take_along_axis(scores, ids, 1), c, settings, searching)
            at_row, places = np.nonzero(keep)
            taken = some.take(pa.array(at_row))
            taken = taken.set_column(names.index("part"), "part", pa.array(ids[at_row, places].astype(np.int32)))
            out.append(taken.set_column(names.index("d"), "d", pa.array(far[at_row, places])))
        return pa.concat_tables(out)

    return run


def _second_level(postings: DataFrame, probes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Both with the lists of more than ``split`` vectors divided into parts."""
    sizes = checkpoint(postings.groupBy("dim", "list").agg(F.count("*").alias("n")).where(F.col("n") > settings.split))
    if sizes.isEmpty():
        return postings, probes
    at = ["dim", "list"]
    # about part_sample vectors of each list, by their hashes
    some = postings.join(F.broadcast(sizes), at).where(F.pmod(F.xxhash64("q", F.lit("part")), F.col("n")) < settings.part_sample)  # at most max_lists rows for each length
    parts = checkpoint(some.select("dim", "list", "n", "q", "vec").groupBy(*at).applyInArrow(_fit_parts(settings), "dim int, list int, part int, c array<float>"))

    def divided(df: DataFrame, searching: bool) -> DataFrame:
        counts = df.groupBy(*at).agg(F.ceil(F.count("*") / settings.chunk).cast("int").alias("chunks"))
        counts = checkpoint(counts.join(F.broadcast(sizes.select(*at)), at))
        held = df.join(F.broadcast(counts), at, "left")
        cut = held.where("chunks IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("q", F.lit("chunk")), F.col("chunks")).cast("int"))
        told = parts.join(F.broadcast(counts), at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        told = told.select(*(F.col(c).alias(f"p_{c}") for c in ("dim", "list", "chunk")), "part", "c")
        own = cut.groupBy("dim", "list", "chunk").cogroup(told.groupBy("p_dim", "p_list", "p_chunk")).applyInArrow(_deal_parts(settings, searching, df.columns), df.schema)
        return checkpoint(held.where("chunks IS NULL").select(*df.columns).unionByName(own))

    postings, probes = divided(postings, False), divided(probes, True)
    # over all lists that a query reads: the nearest parts, by the same rules
    near = Window.partitionBy("dim", "q")
    ranked = probes.withColumn("least", F.min("d").over(near)).withColumn("place", F.row_number().over(near.orderBy("d", "list", "part")))
    probes = ranked.where((F.col("place") <= settings.beam) & (F.col("d") <= settings.search_ratio * F.col("least") + 1e-9)).drop("least", "place")
    return postings, checkpoint(probes)


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            v, q = _scaled(_matrix(left.column("vec").combine_chunks())), _scaled(_matrix(right.column("asked").combine_chunks()))
            ids, keys = left.column("ids").to_pylist(), right.column("q").to_pylist()
            dots = _unit(q) @ _unit(v).T
            # all that reach the k-th, with room for rounding and ties
            wide = dots >= np.partition(dots, -min(k, dots.shape[1]), axis=1)[:, -min(k, dots.shape[1])][:, None] - 1e-9
            many = np.cumsum(wide.sum(1))
            limit, at = max(1, (1 << 22) // q.shape[1]), 0
            while at < len(q):  # some rows at a time, so that ties of many vectors are not all spread out
                stop = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + limit, side="right")))
                rows, columns = np.nonzero(wide[at:stop])
                best: dict[int, list] = {}
                for r, c, s in zip(rows.tolist(), columns.tolist(), _stable_cosine(q[at + rows], v[columns]).tolist(), strict=True):
                    best.setdefault(r, []).extend((-s, i) for i in ids[c])
                out += [(keys[at + r], i, -s) for r, found in best.items() for s, i in sorted(found)[:k]]
                at = stop
        return pa.table({"q": pa.array([o[0] for o in out], pa.binary()), "id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    return run


def _graphs(entries: DataFrame, settings: Settings) -> dict[int, Graph]:
    """The centroids of each vector length that has enough for two lists; what is collected is bounded for all lengths together."""
    counts = {r.dim: r.n for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length
    total, out = sum(counts.values()), {}
    for dim, n in sorted(counts.items()):
        size = max(2, min(settings.sample, settings.sample_values // dim) * n // total)
        lists = 1
        while lists * 2 * settings.list_size <= n and lists * 2 <= min(settings.max_lists, size):
            lists *= 2
        if lists > 1:
            picked = entries.where(F.col("dim") == dim).orderBy(F.xxhash64("q"), "q").limit(size).select("vec").toArrow()
            sample = _unit(_matrix(picked.column("vec").combine_chunks()).astype(np.float64))
            out[dim] = Graph(balanced_centroids(sample, lists), settings.degree)
    return out


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of df that meets ``is_query``, its own row left out.

    Ties go to the smaller id. Vectors that are null or zero or hold null or non-finite components take no part,
    nor do null keys. Vectors are compared with those of their own length. Rows that repeat a key with
    the same vector count once. No vectors, no rows.
    """
    source = df.select(named(key).cast("long").alias("id"), named(vector).cast("array<double>").alias("vec"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    source = source.withColumn("q", F.unhex(F.md5(F.to_json(F.struct("vec")))))
    order = Window.partitionBy("q").orderBy("id")
    few = source.groupBy("q", "id").agg(F.first("vec").alias("vec")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = few.groupBy("q").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = checkpoint(entries.select(F.size("vec").alias("dim"), "q", "vec", "ids"))
    asks = checkpoint(source.where(F.coalesce("asks", F.lit(False))).select("id", "q").distinct())
    if entries.isEmpty():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most max_lists centroids of a length: what is broadcast does not grow with the table
    graphs = df.sparkSession.sparkContext.broadcast(_graphs(entries, settings))

    shape = "dim int, list int, part int, d double, q binary, vec array<double>"
    postings = checkpoint(entries.mapInArrow(_lists_of(graphs, settings, False), shape + ", ids array<long>"))
    probes = asks.select("q").distinct().join(entries.select("dim", "q", "vec"), "q").select("dim", "q", "vec").mapInArrow(_lists_of(graphs, settings, True), shape)
    postings, probes = _second_level(postings, checkpoint(probes), settings)
    at = ["dim", "list", "part"]
    tiles = lambda t: F.ceil(t / settings.tile).cast("int")
    counts = postings.groupBy(*at).agg(tiles(F.count("*")).alias("blocks")).join(probes.groupBy(*at).agg(tiles(F.count("*")).alias("sides")), at)
    own = lambda of: F.pmod(F.xxhash64("q", F.lit("tile")), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = postings.join(counts, at).withColumn("block", own("blocks")).withColumn("side", every("sides")).select(*at, "block", "side", "vec", "ids")
    right = probes.join(counts, at).withColumn("side", own("sides")).withColumn("block", every("blocks")).select(*at, "block", "side", "q", F.col("vec").alias("asked"))
    at = [*at, "block", "side"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_tile(k + 1), "q binary, id long, score double")
    best = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    answers = asks.withColumnRenamed("id", "query_id").join(best, "q").where(F.col("id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
