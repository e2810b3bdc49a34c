"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts are first reduced to classes of equal word sequences, so exact copies cost one row each. Every
class has a signature: for each of ``trees`` trees a path of ``depth`` MinHash values of 16 bits, as bytes whose
order is that of the tree's sorted trie, so that a prefix of the bytes is a node. Two classes are compared if in some tree the prefix that
counts for both is the same: they are in one bucket.

Prefixes start at the full depth and are shortened one value at a time. A matched prefix that holds ``small_bucket`` classes or fewer
is shortened on, as it costs little; one that would be crowded is shortened only while one of its classes has not reached the target:
the chance 1 - prod(1 - threshold ** depth of its prefix in a tree) that it meets a partner at the threshold. So classes of crowded
and of thin regions end at different depths, and all reach the recall. At ``prefix_depth`` the target holds even if all trees stop
there; thin prefixes go one value further, which leaves room for the crowded ones to stay long.

* Buckets of ``PAIRS`` classes or fewer give pairs, each once, which are verified on the exact shingle sets.
* Larger buckets that overlap make a region. Where comparing all of a region once takes no more pairs than comparing each of its
  buckets, as with a group of near copies that meet in nearly all trees, the region takes the buckets' place.
* A region, or a bucket of more than ``PAIRS`` classes, is cut into blocks; tiles of two blocks are counted by a matrix
  product, and give one row for each member: its number of links and an edge that keeps the tile's
  links connected. So a large group of near copies makes no row for each pair, and still each of its
  pairs is compared. A bucket's tile reads the sets of those members only that have a pair which no earlier tree held.

Groups are the connected components of the links, found by label propagation with checkpoints; labels are ordered by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bitmap, checkpoint, few_rows, free_name, map_batches, marked, mix64, named, runs_of, signed, slices, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: Trees of the forest, hash values on a path and bytes of each, and the share of pairs at the threshold that must meet.
TREES, DEPTH, BYTES, RECALL = 32, 7, 2, 0.9999
#: Classes of a node up to which it is not crowded, of a bucket up to which it gives pairs in each of its trees, and members of a block of a larger bucket.
SMALL, PAIRS, BLOCK = 64, 32, 256


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets with the target recall if it counts in all trees."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("the forest is too small for this recall")


def signatures(shingles: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """An array (text, tree, depth) of 16-bit MinHash values; zeros for a text without shingles."""
    full = counts > 0
    out = np.zeros((len(counts), trees, depth), dtype=">u2")
    if not full.any():
        return out
    starts = (np.cumsum(counts) - counts)[full]
    rng = np.random.Generator(np.random.PCG64(20240229))
    odd = rng.integers(1, 2**63, size=(trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, size=(trees, depth), dtype=np.uint64)
    values = np.empty_like(shingles)
    for t in range(trees):
        for k in range(depth):
            # the high half of a product is mixed, its low bits are not
            np.bitwise_xor(shingles, shift[t, k], out=values)
            np.multiply(values, odd[t, k], out=values)
            np.right_shift(values, np.uint64(24), out=values)
            least = np.minimum.reduceat(values, starts)
            out[full, t, k] = mix64(least) & np.uint64(0xFFFF)
    return out


def _keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word sequence, as rows."""
    out = np.zeros((len(counts), 2), dtype=np.uint64)
    if len(words):
        full = counts > 0
        place = np.arange(len(words), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
        for j in range(2):
            salted = mix64(words ^ (place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j * 0x165667B19E3779F9 + 1)))
            out[full, j] = np.add.reduceat(salted, (np.cumsum(counts) - counts)[full])
    out[:, 1] += counts.astype(np.uint64)
    return out


def _distinct(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts)
    return [np.unique(shingles[e - c : e]) for e, c in zip(ends, counts, strict=True)]


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(named(key).cast("long").alias("id"), named(text).cast("string").alias("text"))


def classes(docs: DataFrame, key: str, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """id, k1, k2, n_shingles, signature: one row per row of docs; equal word sequences have equal (k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, counts = word_hashes(batch.column(1))
            shingles, n = runs_of(hashes, counts, words)
            keys = _keys(hashes, counts)
            packed = signatures(shingles, n, trees, depth).reshape(len(n), -1)
            paths = pa.array([row.tobytes() if m else None for row, m in zip(packed, n, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(np.ascontiguousarray(keys[:, 0])), signed(np.ascontiguousarray(keys[:, 1])), pa.array(n), paths], names=["id", "k1", "k2", "n_shingles", "signature"])

    return _slim(docs, key, text).mapInArrow(run, "id long, k1 long, k2 long, n_shingles long, signature binary")


def _node(depth: int) -> Column:
    return F.substring("path", 1, BYTES * depth)


def buckets(reps: DataFrame, trees: int, depth: int, shortest: int, threshold: float, recall: float, small: int) -> DataFrame:
    """tree, rep, depth, bucket, members: the node that each class (rep, signature) ends at in each tree where another one ends there too."""
    cut = F.substring("signature", F.col("tree") * (BYTES * depth) + 1, F.lit(BYTES * depth))
    paths = reps.select("rep", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", "rep", cut.alias("path"))
    paths = paths.withColumn("node", _node(shortest))
    sizes = checkpoint(paths.groupBy("tree", "node").agg(F.count("*").alias("members")).where("members > 1"))
    # crowded nodes are told to the paths first, so that none of their many rows is dealt out by its node
    marks = few_rows(sizes.where(F.col("members") > small).select("tree", "node", F.lit(True).alias("crowded")))
    paths = paths.join(marks, ["tree", "node"], "left")
    shared = paths.where("crowded IS NULL").join(sizes.where(F.col("members") <= small), ["tree", "node"]).select("tree", "rep", "path", "members")
    name = F.expr(f"xxhash64(tree, depth, substring(path, 1, {BYTES} * depth)) | 1").alias("bucket")
    calm = checkpoint(shared.withColumn("depth", F.lit(shortest)).select("tree", "rep", "depth", name, "members"))
    crowd = checkpoint(paths.where("crowded").select("tree", "rep", "path"))
    if crowd.isEmpty():
        return calm
    # the sizes of all nodes, from the full paths upwards, and with them the shortest prefix of each path that is not crowded
    full = crowd.groupBy("tree", "path").agg(F.count("*").alias("n"))
    ends, above = full.select("tree", "path").withColumn("depth", F.lit(depth)), full
    for d in range(depth - 1, shortest, -1):
        above = above.groupBy("tree", _node(d).alias("path")).agg(F.sum("n").alias("n"))
        free = above.where(F.col("n") <= small).select("tree", F.col("path").alias("node"), F.lit(d).alias("d"))
        ends = ends.withColumn("node", _node(d)).join(free, ["tree", "node"], "left").select("tree", "path", F.coalesce("d", "depth").alias("depth"))
    crowd = checkpoint(crowd.join(ends, ["tree", "path"]).select("tree", "rep", "path", "depth"))
    # a class lacks recall while the chance that all its trees miss is above the target's; trees out of the crowd end at the shortest prefix
    miss = F.sum(F.log1p(-F.pow(F.lit(threshold), F.col("depth")))) + (trees - F.count("*")) * float(np.log1p(-(threshold**shortest)))
    for d in range(depth - 1, shortest - 1, -1):
        lacking = crowd.groupBy("rep").agg(miss.alias("miss")).where(F.col("miss") > float(np.log1p(-recall))).select("rep")
        short = checkpoint(crowd.where(F.col("depth") > d).join(lacking, "rep", "left_semi").select("tree", _node(d).alias("node")).distinct().withColumn("hit", F.lit(True)))
        if short.isEmpty():
            continue
        # all classes below a node that is shortened come to stand at it; few nodes are told to the paths, which then are not dealt out by node
        moved = F.when(F.col("hit") & (F.col("depth") > d), F.lit(d)).otherwise(F.col("depth"))
        crowd = checkpoint(crowd.withColumn("node", _node(d)).join(few_rows(short), ["tree", "node"], "left").select("tree", "rep", "path", moved.alias("depth")))
    crowd = crowd.select("tree", "rep", "depth", name)
    members = crowd.groupBy("tree", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    return calm.unionByName(crowd.join(members, ["tree", "bucket"]).select("tree", "rep", "depth", "bucket", "members"))


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """k1, k2, grams (binary: sorted distinct 64-bit shingles) of the classes in ``wanted`` (id, k1, k2), each from one row of docs.

    A bounded bitmap of (id, class) lets nearly only the wanted rows' sets through before the exact join.
    """
    tagged = wanted.select("id", "k1", "k2", F.expr("k1 + id * 31").alias("mark"))
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(tagged, "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, counts = word_hashes(batch.column(1))
            keys = _keys(hashes, counts)
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            hit = marked(marks.value, keys[:, 0] + ids * np.uint64(31)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            keep = np.repeat(hit, counts)
            shingles, n = runs_of(hashes[keep], counts[hit], words)
            sets = [s.astype("<u8").tobytes() for s in _distinct(shingles, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit)), signed(np.ascontiguousarray(keys[hit, 0])), signed(np.ascontiguousarray(keys[hit, 1])), pa.array(sets, pa.binary())], names=["id", "k1", "k2", "grams"])

    found = _slim(docs, key, text).mapInArrow(run, "id long, k1 long, k2 long, grams binary")
    return found.join(wanted.select("id", "k1", "k2", "rep"), ["id", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", "grams")


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common) - 1e-9 and common > 0


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "grams_a"), "grams_b"):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [_linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), threshold) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of slices of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sizes = [len(s) for s in left], [len(s) for s in right]
    values, places = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(sizes[0])
    rows_l, rows_r = np.repeat(np.arange(len(left)), sizes[0]), np.repeat(np.arange(len(right)), sizes[1])
    pl, pr = places[:cut], places[cut:]
    shared = np.isin(np.arange(len(values)), pl) & np.isin(np.arange(len(values)), pr)
    new = np.cumsum(shared) - 1
    kl, kr = shared[pl], shared[pr]
    rows_l, pl, rows_r, pr = rows_l[kl], new[pl[kl]], rows_r[kr], new[pr[kr]]
    for at in range(0, int(shared.sum()), columns):
        width = min(columns, int(shared.sum()) - at)
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = (pl >= at) & (pl < at + width), (pr >= at) & (pr < at + width)
        m[rows_l[i], pl[i] - at] = 1
        n[rows_r[j], pr[j] - at] = 1
        out += m @ n.T
    return out


def _packed(members: DataFrame, *columns: str) -> DataFrame:
    """tree, bucket, own, blocks, members: one row for each block of a region or bucket, with its members' rep and further columns."""
    return members.groupBy("tree", "bucket", "own", "blocks").agg(F.collect_list(F.struct("rep", *columns)).alias("members"))


def _unpacked(table: pa.Table) -> pa.Table:
    """A tile's members, one row each, from one row for each of its blocks."""
    table = table.combine_chunks()
    batch = table.to_batches()[0]
    lists = batch.column("members")
    at = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    members = pa.RecordBatch.from_struct_array(lists.flatten())
    names = [c for c in table.column_names if c != "members"]
    return pa.table([*(batch.column(c).take(at) for c in names), *members.columns], names=[*names, *members.schema.names])


def _sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(members by side and rep, places of the left ones, of the right ones, which pairs no earlier tree's bucket holds, whether the block is paired with itself)."""
    table = _unpacked(table).sort_by([("side", "ascending"), ("rep", "ascending")]).combine_chunks()
    side, tree = table.column("side").to_numpy(), table.column("tree")[0].as_py()
    diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    new = np.ones((len(left), len(right)), dtype=bool)
    if tree >= 0:  # a bucket's: pairs of one region count there
        region = table.column("region").to_numpy()
        new &= region[left][:, None] != region[right][None, :]
        large = np.array(table.column("large").combine_chunks().flatten().fill_null(0)).reshape(len(side), -1)
    for t in range(tree):
        new &= (large[left, t][:, None] != large[right, t][None, :]) | (large[left, t] == 0)[:, None]
    if diagonal:
        np.fill_diagonal(new, False)
    return table, left, right, new, diagonal


def _needed(table: pa.Table) -> pa.Table:
    """tree, bucket, i, j, side, own, reps: the members of a tile that have a pair which counts here, a row for each side; no row if there are none."""
    first = table.slice(0, 1)
    table, left, right, new, diagonal = _sides(table)
    reps = table.column("rep").to_numpy()
    found = [(0, "i", reps[left[new.any(1)]]), *(() if diagonal else ((1, "j", reps[right[new.any(0)]]),))] if new.any() else []
    columns = {c: pa.array([first.column(c)[0].as_py()] * len(found), first.schema.field(c).type) for c in ("tree", "bucket", "i", "j")}
    columns |= {"side": pa.array([s for s, _, _ in found], pa.int32()), "own": pa.array([first.column(c)[0].as_py() for _, c, _ in found], pa.int32())}
    return pa.table(columns | {"reps": pa.array([r.tolist() for _, _, r in found], pa.list_(pa.int64()))})


def _tile(threshold: float):
    """Links within a tile: rows (a, b, n): the number of links of member a, and an edge of a forest that spans the tile's links."""

    def run(table: pa.Table) -> pa.Table:
        table, left, right, linked, diagonal = _sides(table)
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        grams = [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty
        common = _common_counts([grams[x] for x in left], [grams[x] for x in right])
        sizes = np.array([len(g) for g in grams], dtype=np.float64)
        linked &= (common > 0) & (common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9)
        if not linked.any():
            return empty
        degree: dict[int, int] = {}
        for members, totals in ((left, linked @ copies[right]), *(() if diagonal else ((right, linked.T @ copies[left]),))):
            for m, n in zip(members, totals, strict=True):
                if n:
                    degree[m] = degree.get(m, 0) + int(n)
        parent = {m: m for m in degree}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(len(left)):
            for j in np.flatnonzero(linked[i]):
                a, b = find(int(left[i])), find(int(right[j]))
                parent[max(a, b)] = min(a, b)
        members = list(degree)
        return pa.table({"a": pa.array([int(reps[m]) for m in members], pa.int64()), "b": pa.array([int(reps[find(m)]) for m in members], pa.int64()), "n": pa.array([degree[m] for m in members], pa.int64())})

    return run


def components(edges: DataFrame, ids: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the least (id, node) of each component; edges: a, b; ids: node, id.

    Labels take the least of their neighbours' and then jump to their label's label.
    """
    ends = edges.where("a <> b").select("a", "b")
    both = checkpoint(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = checkpoint(both.select(F.col("a").alias("node")).distinct().join(ids, "node").select("node", F.struct("id", "node").alias("root")))
    for _ in range(rounds):
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = low.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = low.withColumn("at", F.col("root.node")).join(jump, "at", "left")
        new = checkpoint(new.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _regions(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, region, members of regions that take the place of their buckets; tree, bucket of those buckets) for large buckets (tree, bucket, rep).

    A class belongs to the least class that shares a large bucket with it; a region's buckets are those whose classes all belong to it.
    """
    heads = large.groupBy("tree", "bucket").agg(F.min("rep").alias("head"))
    own = checkpoint(large.join(heads, ["tree", "bucket"]).groupBy("rep").agg(F.min("head").alias("region")))
    of = large.join(own, "rep").groupBy("tree", "bucket").agg(F.min("region").alias("region"), F.max("region").alias("last"), F.count("*").alias("n"))
    pure = checkpoint(of.where(F.col("region") == F.col("last")))
    apart = pure.groupBy("region").agg(F.sum(F.pow("n", F.lit(2))).alias("apart"))
    sizes = own.groupBy("region").agg(F.count("*").alias("members")).join(apart, "region").where(F.pow("members", F.lit(2)) <= F.col("apart")).select("region", "members")
    sizes = few_rows(checkpoint(sizes))
    return own.join(sizes, "region").select("rep", "region", "members"), pure.join(sizes, "region").select("tree", "bucket")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, small_bucket: int = SMALL, block: int = BLOCK) -> DataFrame:
    """key, class_id, n_links, n_copies: one row for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of ``words`` consecutive lower-case
    words is at least ``threshold``; a text of fewer words is one shingle. ``n_links`` counts the other
    rows that a row is linked to, exact copies among them; ``n_copies`` the rows with the same words, itself
    included; ``class_id`` is the least key of the connected component. A text without words (null, empty) has no
    shingles: no links, and its own key as class. Keys must be integers; a row whose key is null has null class and is
    neither linked nor counted. Rows with equal keys are rows of their own with one class each by their text.
    """
    return _grouped(docs, key, text, words, threshold, trees, depth, recall, small_bucket, block).select(F.col("id").alias(key), "class_id", "n_links", "n_copies")


def _grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, small_bucket: int = SMALL, block: int = BLOCK) -> DataFrame:
    """id, k1, k2, root, class_id, n_links, n_copies: as ``join``, with the class of the row's words and its component (null: no words or no key)."""
    shortest = max(1, prefix_depth(threshold, trees, depth, recall) - 1)
    rows = checkpoint(classes(docs, key, text, words, trees, depth))
    valid = rows.where("id IS NOT NULL AND n_shingles > 0")
    # numbers, not hashes, name the classes: they are fixed once they are written, and no two are equal
    reps = checkpoint(valid.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("signature").alias("signature")).withColumn("rep", F.monotonically_increasing_id()))
    members = checkpoint(buckets(reps, trees, depth, shortest, threshold, recall, small_bucket))
    most = min(small_bucket, PAIRS)
    small, large = members.where(F.col("members") <= most), members.where(F.col("members") > most)
    if large.isEmpty():
        regions = large.select("rep", F.lit(0).cast("long").alias("region"), "members")
    else:
        regions, done = _regions(large)
        regions, large = checkpoint(regions), checkpoint(large.join(done, ["tree", "bucket"], "left_anti"))
    flags = large.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("at"))  # one of each tree at most
    flags = flags.select("rep", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.try_element_at("at", t)).alias("large"))
    held = members.select("rep").distinct().join(flags, "rep", "left").join(regions.select("rep", "region"), "rep", "left")
    wanted = checkpoint(held.join(reps.drop("signature"), "rep").select("rep", "id", "k1", "k2", "copies", "large", "region"))
    sets = checkpoint(shingle_sets(docs, key, text, words, wanted))

    left, right = small.select("tree", "bucket", F.col("rep").alias("a")), small.select("tree", "bucket", F.col("rep").alias("b"))
    pairs = left.join(right, ["tree", "bucket"]).where("a < b").select("a", "b").distinct()
    # a pair that also meets in a region or a large bucket is counted there
    info = checkpoint(wanted.where("large IS NOT NULL OR region IS NOT NULL").select("rep", "large", "region"))
    if not info.isEmpty():
        meets = F.exists(F.arrays_zip("large_a", "large_b"), lambda x: F.coalesce(x["large_a"] == x["large_b"], F.lit(False)))
        for side in "ab":
            pairs = pairs.join(info.select(F.col("rep").alias(side), F.col("large").alias(f"large_{side}"), F.col("region").alias(f"region_{side}")), side, "left")
        pairs = pairs.where(~F.coalesce(meets, F.lit(False)) & ~F.coalesce(F.col("region_a") == F.col("region_b"), F.lit(False))).select("a", "b")
    with_sets = pairs.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("grams_b")), "b")
    links = checkpoint(with_sets.select("a", "b", "grams_a", "grams_b").mapInArrow(_verify(threshold), "a long, b long"))

    cut = large.select("tree", "bucket", "rep", "members").unionByName(regions.select(F.lit(-1).alias("tree"), F.col("region").alias("bucket"), "rep", "members"))
    cut = cut.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    at = ["tree", "bucket", "i", "j"]
    # a tile is made of two rows, its blocks: as many rows as blocks go with each of a region or bucket, not with each of its members
    sides = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "own", "members"]
    every = lambda packs: packs.select("tree", "bucket", "own", "members", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("tree", "bucket", *sides)
    own = F.coalesce("region", -1 - F.col("rep")).alias("region")  # a class without a region is one of its own
    light = _packed(cut.where("tree >= 0").join(info.select("rep", "large", own), "rep"), "large", "region")
    some = checkpoint(every(light).groupBy(*at).applyInArrow(_needed, "tree int, bucket long, i int, j int, side int, own int, reps array<long>"))
    needed = some.groupBy("tree", "bucket", "own").agg(F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps")).select("tree", "bucket", "own", F.lit(0).alias("blocks"), F.explode("reps").alias("rep"))
    # what a tile needs of a member is put together once, not for each of its tiles
    whole = sets.join(wanted.select("rep", "copies", "large", own), "rep")
    packs = _packed(cut.where("tree < 0").select("tree", "bucket", "own", "blocks", "rep").unionByName(needed).join(whole, "rep"), "copies", "large", "region", "grams")
    tiles = every(packs.where("tree < 0")).drop("own").unionByName(packs.where("tree >= 0").select("tree", "bucket", "own", "members").join(some.select(*at, "side", "own"), ["tree", "bucket", "own"]).drop("own"))
    counted = checkpoint(tiles.groupBy(*at).applyInArrow(_tile(threshold), "a long, b long, n long"))

    copies = reps.select("rep", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ends.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("n")).unionByName(counted.groupBy("a").agg(F.sum("n").alias("n")))
    counts = counts.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    roots = components(links.unionByName(counted.select("a", "b")), reps.select(F.col("rep").alias("node"), "id")).withColumnRenamed("node", "rep")
    known = reps.join(roots, "rep", "left").join(counts, "rep", "left")
    known = known.select("k1", "k2", F.coalesce("root.node", "rep").alias("root"), F.coalesce("root.id", "id").alias("class_id"), "copies", F.coalesce("n", F.lit(0)).alias("n"))
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    out = rows.select("id", "k1", "k2", "n_shingles").join(known, ["k1", "k2"], "left")
    return out.select(
        "id",
        "k1",
        "k2",
        F.when(~alone, F.col("root")).alias("root"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )


def _with_class(docs: DataFrame, text: str, k1: str, k2: str) -> DataFrame:
    """docs with the class of each row's words in columns of their own."""
    plain = free_name(docs, "plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, plain):
            keys = _keys(*word_hashes(batch.column(batch.num_columns - 1)))
            arrays = [*batch.columns[:-1], *(signed(np.ascontiguousarray(keys[:, i])) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], k1, k2])

    out = T.StructType([*docs.schema.fields, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())])
    return map_batches(docs.withColumn(plain, named(text).cast("string")), run, out)


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each group the row with the least key.

    Rows with null keys and texts without words stay. A key that stands for texts of several groups is taken for a
    group only if it has no other key, and each of its rows goes or stays by its own text. Of rows with one key in one
    group, and of equal texts without words, one stays, the least text.
    """
    groups = checkpoint(_grouped(docs, key, text, **options).select("id", "k1", "k2", "root", "class_id"))
    shared = checkpoint(groups.where("root IS NOT NULL").groupBy("id").agg((F.min("root") != F.max("root")).alias("shared")).where("shared"))
    if not shared.isEmpty():
        touched = groups.join(shared, "id", "left").withColumn("shared", F.coalesce("shared", F.lit(False))).where("root IS NOT NULL").groupBy("root")
        better = touched.agg(F.min(F.struct("shared", "id")).alias("m"), F.max("shared").alias("any")).where("any").select("root", F.col("m.id").alias("least"))
        groups = checkpoint(groups.join(better, "root", "left").select("id", "k1", "k2", "root", F.coalesce("least", "class_id").alias("class_id")))
    keys = groups.where("id IS NOT NULL").groupBy("id").agg((F.count("*") > 1).alias("again"), F.max(F.col("id") != F.col("class_id")).alias("moved"))
    number, again = free_name(docs, "number"), free_name(docs, "again")
    touched = checkpoint(keys.where("again OR moved").select(F.col("id").alias(number), F.col("again").alias(again)))
    columns = [named(c) for c in docs.columns]
    numbered = docs.withColumn(number, named(key).cast("long"))
    alone = numbered.join(touched, number, "left_anti").select(*columns)

    several = touched.where(F.col(again)).select(number)
    k1, k2, own = free_name(docs, "k1"), free_name(docs, "k2"), free_name(docs, "own")
    held = _with_class(numbered.join(several, number, "left_semi").select(*columns, number), text, k1, k2)
    first = groups.where("id = class_id").select(F.col("id").alias(number), F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("root").alias(own)).distinct()
    held = held.join(first, [number, k1, k2])
    # without words there is no group: equal texts count as one
    part = [F.col(number), F.col(own), F.when(F.col(own).isNull(), named(text))]
    place = Window.partitionBy(*part).orderBy(named(text))
    held = held.select(*columns, F.row_number().over(place).alias(own)).where(F.col(own) == 1)
    return alone.unionByName(held.select(*columns))
