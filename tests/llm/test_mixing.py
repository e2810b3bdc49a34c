"""Mixing against a plain solution of the same problem."""

import math
import re

import pytest
from pyspark.sql import functions as F

from docketlake.llm import mixing, op2


def targets(sizes, total):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


def docs(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, " ".join(["w"] * (1 + (i * i) % 53))) for i in range(700)]
    rows += [(9000 + i, "s1", "same text here") for i in range(400)] + [(9000, "s1", "same text here"), (9999, "", None), (9998, "zero", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_copies(spark):
    df = docs(spark)
    size = {}
    for r in df.collect():
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(size, 1.5 * sum(size.values()))
    rows = op2.mixed(df).collect()
    assert len(rows) == df.count()
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    key = lambda r: (r.doc_id, r.source or "", r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, op2.mixed(df.repartition(7)).collect()))


def test_rates_are_the_entropy_optimum(spark):
    cells = spark.createDataFrame([("a", 1, 10), ("a", 5, 4), ("a", 20, 2)], "key string, size long, n long")
    for target in (12.0, 60.0, 100.0, 139.0):
        duals = mixing.multipliers(cells, spark.createDataFrame([("a", 70, target)], "key string, size long, target double"))
        got = {r["size"]: r.rate for r in mixing.rates(cells, duals).collect()}
        low, high = -50.0, 50.0
        for _ in range(200):
            x = (low + high) / 2
            if sum(n * s * min(2, math.exp(x * s)) for s, n in ((1, 10), (5, 4), (20, 2))) < target:
                low = x
            else:
                high = x
        for s in (1, 5, 20):
            assert got[s] == pytest.approx(min(2, math.exp(low * s)), rel=1e-6, abs=1e-9)


def test_hot_cells_are_dealt_by_salt(spark):
    df = spark.createDataFrame([(i, "a", 3) for i in range(1000)] + [(5000 + i, "b", 1) for i in range(9)], "doc_id long, source string, size long")
    rows = mixing.mix(df, spark.createDataFrame([("a", 1000.0)], "source string, target double"), chunk=50).collect()
    assert sum(r.taken for r in rows if r.source == "a") in (999, 1002)
    assert all(r.copies == 0 for r in rows if r.source == "b")


def test_clashing_columns(spark):
    df = docs(spark).limit(50).select("*", *(F.lit(7).alias(c) for c in ("n", "key", "rate", "target", "salts", "_key", "copies", "taken", "_h")))
    out = op2.mixed(df)
    assert out.count() == 50 and {r._key for r in out.collect()} == {7} and out.columns.count("copies") == 1


def test_empty_table(spark):
    assert op2.mixed(docs(spark).limit(0)).count() == 0


def test_only_sql_runs(spark):
    plan = mixing.mix(docs(spark).withColumn("size", mixing.size_of(F.col("text"))), spark.createDataFrame([("s1", 10.0)], "source string, target double"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
