"""8-bit codes: the best inner products equal those of all pairs, and few are computed in double precision."""

import math

import numpy as np
from pyspark.sql import functions as F

from docketlake.operators import codes, rank
from docketlake.plans import retrieval
from docketlake.storage import new_folder


def made(spark, x, groups=3):
    return spark.createDataFrame([(f"g{i % groups}", i % groups, f"c{i}", f"d{i // 4}", "t", v if v is None else [float(c) if c is not None else None for c in v]) for i, v in enumerate(x)], "collection string, collection_ord int, chunk_id string, doc_id string, text string, embedding array<float>")


def rows(df):
    return sorted((r.query_id, r.collection, r.pos, r.chunk_id, r.score) for r in df.collect())


def plain(x, queries, k, groups=3, among=None):
    out = []
    for q, v in queries:
        for g in range(groups):
            own = [(-round(float(np.dot(np.array(x[i], np.float32).astype(float), v)), 6) + 0.0, f"c{i}") for i in range(g, len(x), groups) if x[i] is not None and len(x[i]) == len(v) and all(c is not None and math.isfinite(c) for c in x[i]) and (among is None or q not in among or f"d{i // 4}" in among[q])]
            out += [(q, f"g{g}", p, c, -s + 0.0) for p, (s, c) in enumerate(sorted(own)[:k], 1)]
    return sorted(out)


def data(n=900, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dim)) * rng.uniform(0.1, 5, size=(n, 1))).astype(np.float32).tolist()
    x[100:130] = [x[7]] * 30
    x[131] = [0.0] * dim
    return x, [(f"q{i}", rng.normal(size=dim).tolist()) for i in range(12)]


def test_equal_to_all_pairs(spark):
    x, queries = data()
    x[3], x[4], x[5], x[6] = None, [1.0], [math.nan] * 32, [None] * 32
    vectors = spark.createDataFrame([*queries, ("none", None), ("other", [1.0])], "query_id string, vector array<double>")
    want = plain(x, [*queries, ("other", [1.0])], 5)
    assert rows(retrieval.dense_hits(made(spark, x), vectors, 5)) == want
    written = codes.write(made(spark, x).repartition(5), new_folder(spark, "codes"))
    assert rows(retrieval.dense_hits(written, vectors, 5)) == want
    assert retrieval.dense_hits(written, vectors.limit(0), 5).count() == 0 and retrieval.dense_hits(written.limit(0), vectors, 5).count() == 0


def test_few_double_products(spark):
    x, queries = data(6000, 64)
    chunks = codes.coded(made(spark, x, 1)).repartition(4)
    near = codes.candidates(chunks, spark.createDataFrame(queries, "query_id string, vector array<double>"), 10)
    assert near.count() < len(x) * len(queries) / 8
    scan = chunks.select("collection", "chunk_id", *codes.COLUMNS)
    assert "embedding" not in scan.columns


def test_within_allowlists(spark):
    x, queries = data(300)
    vectors = spark.createDataFrame(queries, "query_id string, vector array<double>")
    listed = {"q0": {"d3", "d9"}, "q1": {"d70"}, "q2": set()}
    documents = spark.createDataFrame([(q, d) for q, ds in listed.items() for d in ds], "query_id string, doc_id string")
    modes = spark.createDataFrame([("q0", "applied"), ("q1", "applied"), ("q2", "empty_ignored"), *((q, "none") for q, _ in queries[3:])], "query_id string, mode string")
    got = rows(retrieval.dense_hits(made(spark, x), vectors, 5, retrieval.Allowed(documents, modes)))
    assert got == plain(x, queries, 5, among={q: listed[q] for q in ("q0", "q1")})


def test_bounds_hold_and_ties_stay(spark):
    x = np.random.default_rng(0).normal(size=(50, 1500)) * 100
    q, scale, error, norm = codes.quantised(x)
    exact = x @ x.T
    off = np.abs(exact - (q.astype(float) @ q.T) * scale[:, None] * scale[None, :])
    assert (off <= (norm + error)[:, None] * error[None, :] + error[:, None] * norm[None, :]).all()
    same = [[1.0, 2.0, 3.0]] * 40
    got = rows(retrieval.dense_hits(made(spark, same, 1), spark.createDataFrame([("q", [1.0, 1.0, 1.0])], "query_id string, vector array<double>"), 7))
    assert [r[3] for r in got] == sorted(f"c{i}" for i in range(40))[:7]
    flat = codes.best(made(spark, same, 1), spark.createDataFrame([("q", [1.0, 1.0, 1.0])], "query_id string, vector array<double>"), 7)
    assert rank.top(flat, ["query_id"], [F.col("chunk_id")], 1).first().score == 6.0
