"""Near-duplicate vectors by int8 tile products with rigorous bounds of the quantisation error.

* Equal vectors are one class. Classes of one length are dealt to blocks by their hash, and every two blocks meet in a tile.
* A unit vector u is kept as integers q of one byte and a scale s, with e, the length of u - s * q. For two vectors the true cosine
  differs from s1 * s2 * (q1 . q2) by e1 + e2 + e1 * e2 at most, and by what rounding adds. The integer products of a tile
  are one matrix product, which is exact: sums are kept under 2 ** 24.
* A pair whose upper bound is under the threshold is none, one whose lower bound reaches it is a link. The members of the
  pairs between are fetched in full precision, tile by tile, and only such pairs are computed again.
* A tile gives one row: for its linked members the number of their links, and edges that keep its links connected. A
  large group of near copies makes no row for each pair.

The cost is that of comparing all pairs, one byte a component: with n vectors in blocks of b, n / b copies of each vector are
shuffled. b grows with n up to ``values`` components, which a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, few_rows, named
from .ann import _matrix, _scaled, _stable_cosine, _unit, usable
from .components import components, dealt_join, heavy

THRESHOLD = 0.9
#: Blocks that a length is cut into at least, vectors of a block at least, and components of a block at most (about 4 MB as bytes).
BLOCKS, LEAST, VALUES = 12, 256, 1 << 22
#: Entries of a product that a task holds at once.
CELLS = 1 << 20
#: Components whose products of two bytes sum to less than 2 ** 24.
EXACT = (1 << 24) // (127 * 127)
#: What rounding in double precision may add to a bound, for each component.
ROUNDING = 1e-14
#: Positions of a block in the number of a class.
PLACES = 1 << 24


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integers of one byte, scale, bound of the error's length) of the unit vectors of rows x."""
    u = _unit(x)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(u - scale[:, None] * q, axis=1)
    return q, scale, error * (1 + 1e-12) + ROUNDING * x.shape[1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of rows of bytes, as float32 where one part holds all components, else as float64."""
    out = a[:, :EXACT].astype(np.float32) @ b[:, :EXACT].astype(np.float32).T
    for at in range(EXACT, a.shape[1], EXACT):
        out = out.astype(np.float64) + a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


class Forest:
    """Union-find over the members of a tile; the edges that joined two parts connect what its links connect."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def link(self, rows: np.ndarray, columns: np.ndarray, mask: np.ndarray) -> None:
        """Take in the links of a mask between numbered rows and columns, each of which has one."""
        label_r, label_c = rows.astype(np.int64), None
        while True:  # the least number of a row that a row reaches within the mask
            new_c = np.where(mask, label_r[:, None], PLACES * PLACES).min(axis=0)
            new_r = np.minimum(label_r, np.where(mask, new_c[None, :], PLACES * PLACES).min(axis=1))
            if label_c is not None and (new_r == label_r).all() and (new_c == label_c).all():
                break
            label_r, label_c = new_r, new_c
        for a, b in zip(np.concatenate([rows, columns]).tolist(), np.concatenate([label_r, label_c]).tolist(), strict=True):
            x, y = self._root(a), self._root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((a, b))


class Side:
    """Members of a block in a tile: their numbers, bytes, scales, errors and weights."""

    def __init__(self, block: int, places: np.ndarray, q: np.ndarray, scale: np.ndarray, error: np.ndarray, weight: np.ndarray):
        self.nodes = block * PLACES + places
        self.q, self.scale, self.error, self.weight = q, scale, error, weight
        self.links, self.unsure = np.zeros(len(q), np.int64), np.zeros(len(q), bool)


def compare(left: Side, right: Side, same: bool, threshold: float, exact: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Count the links of a tile into both sides and return edges that connect them.

    Without ``exact`` the pairs whose bounds include the threshold are marked at their members; with it, the vectors of both
    sides, only these pairs are computed, and all others are left out.
    """
    forest, n = Forest(), len(right.q)
    step = max(1, CELLS // max(1, n))
    for at in range(0, len(left.q), step):
        stop = min(len(left.q), at + step)
        dots = products(left.q[at:stop], right.q) * (left.scale[at:stop, None] * right.scale[None, :]).astype(np.float32)
        # bounds with room for the rounding of float32; the pairs near them are few and are bounded again in double precision
        room = float(left.error[at:stop].max()) + float(right.error.max())
        near = dots >= threshold - room - room * room - 1e-5
        if same:
            near &= np.arange(n)[None, :] > np.arange(at, stop)[:, None]
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        columns = np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(rows, columns)]
        a = at + rows
        precise = products(left.q[a], right.q[columns]).astype(np.float64) * left.scale[a, None] * right.scale[None, columns]
        el, er = left.error[a, None], right.error[None, columns]
        margin = el + er + el * er + ROUNDING * left.q.shape[1]
        linked = near & (precise - margin >= threshold)
        between = near & ~linked & (precise + margin >= threshold)
        if exact is not None:
            i, j = np.nonzero(between)
            linked = np.zeros(linked.shape, bool)
            for part in range(0, len(i), CELLS // 16):
                r, c = i[part : part + CELLS // 16], j[part : part + CELLS // 16]
                linked[r, c] = _stable_cosine(exact[0][a[r]], exact[1][columns[c]]) >= threshold
        else:
            left.unsure[a] |= between.any(axis=1)
            right.unsure[columns] |= between.any(axis=0)
        rows, used = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if len(rows):
            linked = linked[np.ix_(rows, used)]
            a, b = a[rows], columns[used]
            left.links[a] += linked @ right.weight[b]
            right.links[b] += linked.T @ left.weight[a]
            forest.link(left.nodes[a], right.nodes[b], linked)
    return forest.edges


_RESULT = "low int, high int, nodes array<long>, links array<long>, a array<long>, b array<long>, unsure array<long>"


def _row(low: int, high: int, sides: list[Side], edges: list[tuple[int, int]]) -> pa.Table:
    linked = [(s.nodes[s.links > 0], s.links[s.links > 0]) for s in sides]
    unsure = np.concatenate([s.nodes[s.unsure] for s in sides])
    lists = [np.concatenate([x[0] for x in linked]), np.concatenate([x[1] for x in linked]), [e[0] for e in edges], [e[1] for e in edges], unsure]
    keep = 1 if len(lists[0]) or len(unsure) else 0
    columns = [pa.array([low] * keep, pa.int32()), pa.array([high] * keep, pa.int32()), *(pa.array([x] * keep, pa.list_(pa.int64())) for x in lists)]
    return pa.table(columns, names=["low", "high", "nodes", "links", "a", "b", "unsure"])


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """A block as one row of packed columns, in the order of its members' places, and each class's key."""
    rows = rows.combine_chunks()
    q, scale, error = quantised(_matrix(rows.column("vec").combine_chunks()))
    packed = [q.tobytes(), scale.tobytes(), error.tobytes(), rows.column("members").to_numpy().astype(np.int64).tobytes()]
    keys = pa.array([rows.column("q").to_pylist()], pa.list_(pa.binary()))
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([p], pa.binary()) for p in packed] + [keys], names=["dim", "block", "q8", "scale", "error", "weight", "keys"])


def _tile(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        sides = {}
        for r in rows.select(["block", "q8", "scale", "error", "weight"]).to_pylist():
            weight = np.frombuffer(r["weight"], np.int64)
            q = np.frombuffer(r["q8"], np.int8).reshape(len(weight), -1)
            sides[r["block"]] = Side(r["block"], np.arange(len(weight)), q, np.frombuffer(r["scale"]), np.frombuffer(r["error"]), weight)
        if low not in sides or high not in sides:
            return _row(low, high, list(sides.values()), [])
        edges = compare(sides[low], sides[high], low == high, threshold)
        if low == high:
            return _row(low, high, [sides[low]], edges)
        return _row(low, high, [sides[low], sides[high]], edges)

    return run


def _again(threshold: float):
    """The pairs of a tile that bounds have left open, from the vectors of their members."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        rows = rows.combine_chunks().sort_by("node")
        nodes, vectors, weight = rows.column("node").to_numpy(), _matrix(rows.column("vec").combine_chunks()), rows.column("members").to_numpy()
        q, scale, error = quantised(vectors)
        sides, exact = {}, {}
        for block in {low, high}:
            own = nodes // PLACES == block
            sides[block] = Side(block, nodes[own] % PLACES, q[own], scale[own], error[own], weight[own])
            exact[block] = _scaled(vectors[own])
        edges = compare(sides[low], sides[high], low == high, threshold, (exact[low], exact[high])) if len(sides[low].q) and len(sides[high].q) else []
        for s in sides.values():
            s.unsure[:] = False
        return _row(low, high, [sides[b] for b in sorted(sides)], edges)

    return run


def _blocks_of(lengths: DataFrame, blocks: int, least: int, values: int) -> DataFrame:
    """dim, first, blocks: how many blocks each vector length has, and the number of its first."""
    first, out = 0, []
    for r in lengths.orderBy("dim").collect():  # one row for each vector length
        size = max(1, min(max(least, -(-r.n // blocks)), max(1, values // r.dim)))
        out.append((r.dim, first, -(-r.n // size)))
        first += out[-1][2]
    return lengths.sparkSession.createDataFrame(out, "dim int, first int, blocks int")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, blocks: int = BLOCKS, least: int = LEAST, values: int = VALUES) -> DataFrame:
    """key, n_links, component_id, kept: one row for each row of df.

    Two rows are linked if the cosine of their vectors, in double precision, is ``threshold`` or more. ``n_links`` counts the other
    rows that a row is linked to, equal vectors among them; ``component_id`` is the least key that links reach, the own one
    included; ``kept`` says that the row's key is it. Vectors that are null, empty or zero or hold null or non-finite components, and
    vectors of different lengths, are not linked. Rows that repeat a key are rows of their own. A null key is linked and
    counted and never the least, unless there is no other; then component_id is null and the row is kept. ``threshold`` must be over 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    rows = df.select(named(key).cast("long").alias("id"), named(vector).cast("array<double>").alias("vec"))
    rows = rows.withColumn("q", F.when(usable(F.col("vec")), F.unhex(F.md5(F.to_json(F.struct("vec"))))))
    classes = rows.where(F.col("q").isNotNull()).groupBy("q").agg(F.first("vec").alias("vec"), F.count("*").alias("members"), F.min(F.coalesce("id", F.lit((1 << 63) - 1))).alias("id"))
    classes = checkpoint(classes.withColumn("dim", F.size("vec")))
    lengths = few_rows(_blocks_of(classes.groupBy("dim").agg(F.count("*").alias("n")), blocks, least, values))
    dealt = classes.join(lengths, "dim").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("q"), F.col("blocks"))).cast("int"))
    packed = checkpoint(dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, q8 binary, scale binary, error binary, weight binary, keys array<binary>"))
    numbered = packed.select(F.col("block").cast("long").alias("block"), F.posexplode("keys").alias("place", "q")).select("q", (F.col("block") * PLACES + F.col("place")).alias("node"))
    nodes = checkpoint(numbered.join(classes.select("q", "id", "members", "vec"), "q"))

    last = F.col("first") + F.col("blocks") - 1
    others = packed.drop("keys").join(lengths, "dim").withColumn("other", F.explode(F.sequence("first", last)))
    tiles = others.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "q8", "scale", "error", "weight")
    first = checkpoint(tiles.groupBy("low", "high").applyInArrow(_tile(threshold), _RESULT))
    asked = first.select("low", "high", F.explode("unsure").alias("node"))
    second = checkpoint(asked.join(nodes.select("node", "members", "vec"), "node").groupBy("low", "high").applyInArrow(_again(threshold), _RESULT))
    found = first.unionByName(second)

    links = found.select(F.explode(F.arrays_zip("nodes", "links")).alias("l")).groupBy(F.col("l.nodes").alias("node")).agg(F.sum("l.links").alias("n"))
    edges = found.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")
    roots = components(edges, nodes.select("node", "id"))
    by_class = nodes.select("q", "node", "id", "members").join(links, "node", "left").join(roots, "node", "left")
    by_class = by_class.select("q", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("root.id", "id").alias("component_id"))
    # rows of a vector with very many copies are dealt to several tasks
    whole = dealt_join(rows.select("id", "q"), by_class, "q", "id", few_rows(heavy(rows.where(F.col("q").isNotNull()), "q")), "left")
    component = F.when(F.col("q").isNull(), F.col("id")).otherwise(F.nullif("component_id", F.lit((1 << 63) - 1)))
    return whole.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
