"""Nearest neighbours: two levels of centroids, lengths, extreme values, ties of many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import ann


def answers(df, settings=ann.Settings(), k=5):
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=k, settings=settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_with_a_second_level(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, 16))
    x = centres[rng.integers(0, 200, 12_000)] + 0.7 * rng.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    settings = ann.Settings(list_size=32, max_lists=8, split=300, max_parts=64, part_sample=1500, chunk=700, beam=24, tile=100)
    got = answers(df, settings)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        cos = y @ y[q]
        cos[q] = -9
        hits += len({i for i, _ in found} & set(np.argsort(-cos)[:5].tolist()))
        assert all(abs(s - cos[i]) < 1e-12 for i, s in found)
    assert len(got) == 240 and hits >= 0.9 * 5 * 240


def test_each_length_by_itself(spark):
    rows = [(50 * i, [1.0, float(i), 0.0, 2.0]) for i in range(3)] + [(50 * i + 7, [1.0, float(i), 3.0]) for i in range(3)] + [(350, [0.0, 1.0, 2.0])]
    got = answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {q: sorted(i for i, _ in f) for q, f in got.items()} == {0: [50, 100], 50: [0, 100], 100: [0, 50], 350: [7, 57, 107]}


@pytest.mark.parametrize("size", [1e-200, 1e200, 5e-324, 1.0])
def test_extreme_values(spark, size):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [size, size]), (2, [size, -size])], "vec_id long, embedding array<double>")
    (i, s), (j, t) = answers(df)[0]
    assert (i, j) == (1, 2) and s == pytest.approx(1.0, abs=1e-15) and t == pytest.approx(0.0, abs=1e-15)


def test_many_scaled_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=24)
    x = np.concatenate([base * s for s in rng.uniform(0.5, 2, (3000, 1))]).reshape(3000, 24)
    got = answers(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), ann.Settings(tile=512))
    assert len(got) == 60
    for q in (0, 50, 2950):
        cos = ann._stable_cosine(np.repeat(ann._scaled(x[q : q + 1]), 3000, 0), ann._scaled(x))
        cos[q] = -9
        assert [i for i, _ in got[q]] == np.lexsort((np.arange(3000), -cos))[:5].tolist()


def test_names_with_dots_and_other_columns(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 1, "x") for i in range(60)], "`vec.id` long, `em.b` array<double>, d int, list string")
    out = ann.nearest(df, F.col("`vec.id`") % 50 == 0, key="vec.id", vector="em.b")
    assert out.count() == 10 and out.columns == ["query_id", "rank", "vec_id", "score"]
