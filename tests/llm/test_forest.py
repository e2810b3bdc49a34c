"""The LSH forest: prefixes end at different depths, and every class reaches the recall."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from docketlake.llm import jaccard


def group(rng, start, copies, length=150, changes=6):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_crowded_prefixes_stay_long_while_the_recall_holds(spark):
    rng = random.Random(5)
    rows = group(rng, 0, 90) + group(rng, 1000, 40, changes=16) + [r for i in range(30) for r in group(rng, 2000 + 10 * i, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = jaccard.classes(docs, "doc_id", "text", jaccard.WORDS, jaccard.TREES, jaccard.DEPTH).withColumnRenamed("id", "rep").checkpoint()
    shortest = jaccard.prefix_depth() - 1
    got = jaccard.buckets(reps, jaccard.TREES, jaccard.DEPTH, shortest, jaccard.THRESHOLD, jaccard.RECALL, 16).collect()
    path = {r.rep: bytes(r.signature) for r in reps.collect()}
    width = jaccard.BYTES * jaccard.DEPTH
    at, held = defaultdict(lambda: [shortest] * jaccard.TREES), defaultdict(set)
    for r in got:
        at[r.rep][r.tree] = r.depth
        held[r.tree, r.bucket].add((path[r.rep][r.tree * width :][: jaccard.BYTES * r.depth], r.depth, r.members))
    assert all(len(same) == 1 for same in held.values())  # a bucket is one node
    assert len({r.depth for r in got}) > 1
    assert len({tuple(sorted(d)) for d in at.values()}) > 2  # classes end at different depths
    for depths in at.values():
        assert math.prod(1 - jaccard.THRESHOLD**d for d in depths) <= 1 - jaccard.RECALL + 1e-12


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(6)
    rows, near = group(rng, 0, 200), []
    for i in range(700):
        w = [f"p{i}_{k}" for k in range(200)]
        v = w[: 200 - rng.randint(17, 21)] + [f"q{i}_{k}" for k in range(20)]
        a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (w, v))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            near.append((10_000 + 2 * i, 10_001 + 2 * i))
        rows += [(10_000 + 2 * i, " ".join(w)), (10_001 + 2 * i, " ".join(v))]
    assert len(near) > 200
    out = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), small_bucket=16).collect()}
    assert sum(out[b].class_id == a for a, b in near) >= 0.99 * len(near)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, None, "z")], "`doc.id` long, `te.xt` string, `k1` string")
    got = jaccard.join(df, key="doc.id", text="te.xt")
    assert got.columns == ["doc.id", "class_id", "n_links", "n_copies"] and got.count() == 3
    kept = jaccard.one_per_group(df, key="doc.id", text="te.xt")
    assert kept.columns == df.columns and sorted(r["doc.id"] for r in kept.collect()) == [1, 3]


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 5003}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    ids = spark.range(600).select(F.col("id").alias("node"), (1000 - F.col("id")).alias("id"))
    got = {r.node: r.root.id for r in jaccard.components(edges, ids).collect()}
    assert {got[i] for i in range(201)} == {800} and got[500] == got[501] == 499
