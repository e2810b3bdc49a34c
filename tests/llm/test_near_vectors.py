"""Near-duplicate vectors: equal to all pairs in double precision, at the threshold too; odd input."""

import math

import numpy as np
import pytest

from docketlake.llm import near_vectors
from docketlake.llm.components import components

BIG = (1 << 63) - 1


def plain(rows, threshold=0.9):
    """All pairs, one after another."""
    fine = {}
    for place, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[place] = np.ldexp(np.array(v, float), -int(np.frexp(np.abs(np.array(v, float)).max())[1]))
    near = {p: set() for p in range(len(rows))}
    for a, x in fine.items():
        for b, y in fine.items():
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out = []
    for p, (key, _) in enumerate(rows):
        seen, todo = {p}, [p]
        while todo:
            for q in near[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        ids = [rows[q][0] for q in seen if rows[q][0] is not None]
        least = min(ids) if ids else None
        out.append((key, len(near[p]), least, key == least))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in near_vectors.near_duplicates(df, **options).collect()), key=repr)


def planted(n=400, dim=24, seed=5):
    """Random vectors, exact and near copies, and many pairs just about the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[7] + 0.02 * rng.normal(size=(40, dim))  # a group of near copies
    x[90:130] = x[7]
    for i in range(130, 300):  # cosines between 0.85 and 0.95 to an earlier one
        u = x[i - 130] / np.linalg.norm(x[i - 130])
        w = rng.normal(size=dim)
        w -= (w @ u) * u
        c = 0.9 + (rng.random() - 0.5) / (10 if i % 2 else 1000)
        x[i] = (c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w)) * rng.uniform(0.1, 50)
    return x


@pytest.mark.parametrize("blocks", [1, 7])
def test_against_all_pairs(spark, blocks):
    rows = [(3 * i + 1, v.tolist()) for i, v in enumerate(planted())]
    assert got(spark, rows, blocks=blocks, least=16) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0]), (10, [5.0])]
    rows += [(None, [1.0, 2.0]), (None, [-3.0, 1.0, 1.0]), (11, [1e200, 2e200]), (12, [5e-324, 1e-323]), (13, [-1.0, -2.0]), (None, None)]
    assert got(spark, rows, least=2) == plain(rows)


def test_empty_and_names(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [1.0, 0.01], 6, "y")], "`a.b` long, `v w` array<float>, block int, q string")
    out = near_vectors.near_duplicates(df, "a.b", "v w")
    assert out.columns == ["a.b", "n_links", "component_id", "kept"] and sorted(map(tuple, out.collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    with pytest.raises(ValueError):
        near_vectors.near_duplicates(df, "a.b", "v w", threshold=0.0)


def test_bounds_hold():
    for dim in (3, 64, 2500):
        x = np.random.default_rng(dim).normal(size=(60, dim)) * np.logspace(-3, 3, 60)[:, None]
        q, scale, error = near_vectors.quantised(x)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        whole = near_vectors.products(q, q)
        assert (whole == q.astype(np.int64) @ q.astype(np.int64).T).all()
        off = np.abs(u @ u.T - whole.astype(float) * scale[:, None] * scale[None, :])
        assert (off <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-13).all()


def test_few_pairs_are_computed_again(spark, monkeypatch):
    """Of random vectors none is near the threshold: nothing is computed in full precision."""
    x = np.random.default_rng(0).normal(size=(300, 64))
    q, scale, error = near_vectors.quantised(x)
    side = near_vectors.Side(0, np.arange(300), q, scale, error, np.ones(300, np.int64))
    assert near_vectors.compare(side, side, True, 0.9) == [] and not side.unsure.any() and not side.links.any()


def test_components_with_hubs(spark):
    """A chain, a star and a clique, with keys dealt to parts of three rows."""
    pairs = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(a, b) for a in range(200, 210) for b in range(200, a)] + [(300, 300)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    ids = spark.range(0, 400).selectExpr("id AS node", "1000 - id AS id")
    out = {r.node: r.root.id for r in components(edges, ids, most=3).collect()}
    want = {i: 1000 - 140 for i in range(100, 141)} | {i: 1000 - 49 for i in range(50)} | {i: 1000 - 209 for i in range(200, 210)}
    assert out == want
