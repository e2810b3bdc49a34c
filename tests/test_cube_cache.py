"""Metrics over all groups with bootstrap intervals, and the cache of stages."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import evaluate
from docketlake.sources import cases


def ranks(spark, n=300):
    rng = random.Random(3)
    rows = [(f"q{i}", c, s, rng.choice([None, 1, 2, 4, 7, 12])) for i in range(n) for c in [rng.choice(["direct", "indirect", None])] for s in ("es", "rrf")]
    return rows, spark.createDataFrame(rows, "query_id string, class string, stage string, rank int")


def mean(rows, value):
    return sum(map(value, rows)) / len(rows)


def test_cube_has_every_group_and_tells_nulls_from_totals(spark):
    rows, df = ranks(spark)
    got = {(r["class"], r.stage, r.level): (r.recall_5, r.mrr, r.n) for r in evaluate.recall_cube(df).collect()}
    assert len(got) == 3 * 2 + 3 + 2 + 1
    for (c, s, level), (recall, mrr, n) in got.items():
        own = [r for r in rows if (level & 2 or r[1] == c) and (level & 1 or r[2] == s)]
        assert n == len(own) and recall == pytest.approx(mean(own, lambda r: r[3] is not None and r[3] <= 5)) and mrr == pytest.approx(mean(own, lambda r: 1 / r[3] if r[3] else 0))


def test_weights_are_poisson(spark):
    w = [r.w for r in spark.range(20_000).select(evaluate.poisson_weight(F.col("id"), F.lit(3)).alias("w")).collect()]
    assert sum(w) / len(w) == pytest.approx(1, abs=0.03) and sum(x == 0 for x in w) / len(w) == pytest.approx(0.3679, abs=0.015) and max(w) <= 12


def test_intervals_hold_the_mean_and_narrow(spark):
    _, df = ranks(spark)
    got = {(r["class"], r.stage, r.level, r.metric): (r.low, r.high) for r in evaluate.intervals(df, replicates=60).collect()}
    means = {(r["class"], r.stage, r.level): r for r in evaluate.recall_cube(df).collect()}
    assert set(got) == {(*k, m) for k in means for m in ("recall_5", "recall_10", "mrr")}
    assert all(low - 0.02 <= means[k[:3]][k[3]] <= high + 0.02 and low < high for k, (low, high) in got.items())
    few = df.where("substr(query_id, 2) % 10 = 0")
    wide = {(r["class"], r.stage, r.level, r.metric): r.high - r.low for r in evaluate.intervals(few, replicates=60).collect()}
    assert wide[(None, None, 3, "mrr")] > 2 * (got[(None, None, 3, "mrr")][1] - got[(None, None, 3, "mrr")][0])
    again = {(r["class"], r.stage, r.level, r.metric): (r.low, r.high) for r in evaluate.intervals(df.repartition(7), replicates=60).collect()}
    assert set(again) == set(got) and all(again[k] == pytest.approx(got[k]) for k in got)


def test_a_second_run_makes_only_new_cases(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []

    def make(missing):
        made.append(sorted(r.cache_key for r in missing.select("cache_key").collect()))
        return missing.where("n <> 3").select("cache_key", F.explode(F.sequence(F.lit(1), "n")).alias("pos"))

    def asked(*keys):
        return spark.createDataFrame([(k, int(k[1:])) for k in keys], "cache_key string, n int")

    def rows(df):
        return sorted((r.cache_key, r.pos) for r in df.collect())

    one = [("k1", 1), ("k2", 1), ("k2", 2)]
    assert rows(cases.cached_cases(path, "es", asked("k1", "k2", "k3"), make)) == one
    assert rows(cases.cached_cases(path, "es", asked("k1", "k2", "k3"), make)) == one and made == [["k1", "k2", "k3"]]
    assert rows(cases.cached_cases(path, "es", asked("k3", "k4"), make)) == [("k4", i) for i in range(1, 5)] and made[1:] == [["k4"]]
    assert rows(cases.cached_cases(path, "rrf", asked("k1"), make)) == [("k1", 1)] and made[2:] == [["k1"]]
    got = cases.cached_cases(path, "es", asked("k1"), make)
    assert rows(got) == [("k1", 1)] and len(made) == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan
    assert cases.cached_cases(str(tmp_path / "none"), "es", asked(), lambda m: m.select("cache_key", F.col("n").alias("pos"))).count() == 0
