"""Evaluation of retrieval runs: pass rates, deltas, recall, reciprocal ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("es", "raw_dense", "raw_sparse", "rewritten_dense", "rewritten_sparse", "rrf", "reranker", "agentic")


def pass_rates(ranks: DataFrame) -> DataFrame:
    """run, stage, passed, total; ranks: run, query_id, stage, rank (null: not found), pass_at."""
    return ranks.groupBy("run", "stage").agg(F.count_if(F.coalesce(F.col("rank") <= F.col("pass_at"), F.lit(False))).alias("passed"), F.count("*").alias("total"))


def citation_rates(results: DataFrame) -> DataFrame:
    """run, passed, total by ``citation_valid``; null fails."""
    return results.groupBy("run").agg(F.count_if(F.coalesce("citation_valid", F.lit(False))).alias("passed"), F.count("*").alias("total"))


def comparison(rates: DataFrame, baseline: str, flags: DataFrame) -> DataFrame:
    """run, stage, passed, total, delta, comparable for the runs that are not the baseline; flags: run, skip_agentic.

    The agentic stage compares only between runs that agree on leaving it out.
    """
    base = rates.where(F.col("run") == baseline).select("stage", F.col("passed").alias("_base"))
    own = flags.where(F.col("run") == baseline).select(F.col("skip_agentic").alias("_skip"))
    joined = rates.where(F.col("run") != baseline).join(F.broadcast(base), "stage").join(F.broadcast(flags), "run").crossJoin(F.broadcast(own.limit(1)))
    comparable = (F.col("stage") != "agentic") | F.col("skip_agentic").eqNullSafe(F.col("_skip"))
    return joined.select("run", "stage", "passed", "total", (F.col("passed") - F.col("_base")).alias("delta"), comparable.alias("comparable"))


def citation_deltas(results: DataFrame, baseline: str) -> DataFrame:
    """run, passed, total, delta: passes by valid citations of the other runs against the baseline's; results: run, citation_valid."""
    rates = citation_rates(results)
    base = rates.where(F.col("run") == baseline).select(F.col("passed").alias("_base"))
    return rates.where(F.col("run") != baseline).crossJoin(F.broadcast(base.limit(1))).select("run", "passed", "total", (F.col("passed") - F.col("_base")).alias("delta"))


# The ranks up to which a case passes and passes weakly, by class.
BANDS = {"direct": (5, 10), "indirect": (10, 20), "adversarial": (20, 20)}


def bands(ranks: DataFrame) -> DataFrame:
    """ranks (class, rank) with ``band``: pass, weak or fail."""
    limit = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in BANDS.items() for x in (k, v[i]))), F.col("class"))
    band = F.when(F.col("rank") <= limit(0), "pass").when(F.col("rank") <= limit(1), "weak").otherwise("fail")
    return ranks.withColumn("band", band)


def recall(ranks: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """class, stage, recall at each depth, mean reciprocal rank, n; ranks: query_id, class, stage, rank."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return ranks.groupBy("class", "stage").agg(*map(hit, at), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def _metrics(at: tuple[int, ...]) -> dict:
    """What a row adds to each metric: a hit at each depth and the reciprocal rank."""
    return {f"recall_{k}": F.when(F.col("rank") <= k, 1.0).otherwise(0.0) for k in at} | {"mrr": F.coalesce(1.0 / F.col("rank"), F.lit(0.0))}


def recall_cube(ranks: DataFrame, by: tuple[str, ...] = ("class", "stage"), at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """by, level, the metrics of ``recall``, n: for every group of the columns in ``by``, of each subset of them, and overall.

    ``level`` has a bit for each column that a row sums over, the last column's the lowest, so a null group is not taken for a total.
    """
    means = [F.avg(value).alias(name) for name, value in _metrics(at).items()]
    return ranks.cube(*by).agg(F.grouping_id().alias("level"), *means, F.count("*").alias("n"))


#: Poisson(1) as integer bounds of a uniform 32-bit number: the weight is the number of bounds that it has reached.
_POISSON = tuple(int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12))


def poisson_weight(unit: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a replicate draws a unit (a query): Poisson(1) by a hash of both, the same in every run."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", unit.cast("string"), replicate.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.size(F.filter(F.array(*map(F.lit, _POISSON)), lambda b: b <= drawn))


def intervals(ranks: DataFrame, by: tuple[str, ...] = ("class", "stage"), at: tuple[int, ...] = (5, 10), replicates: int = 200, level: float = 0.95, seed: int = 0, unit: str = "query_id") -> DataFrame:
    """by, level, metric, low, high: bootstrap intervals of the metrics of ``recall_cube``, in one pass over ranks.

    A replicate draws each query a Poisson number of times, in all its rows alike, so stages are compared on the same draws. A replicate that draws no
    row of a group is left out of the group's interval. Rows are multiplied by the replicates and summed before they are shuffled.
    """
    names = list(_metrics(at))
    drawn = ranks.withColumn("_replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_weight", poisson_weight(F.col(unit), F.col("_replicate"), seed)).where("_weight > 0")
    sums = [F.sum(F.col("_weight") * value).alias(name) for name, value in _metrics(at).items()]
    # the replicate stays in all groups: its bit of the grouping number is the lowest
    each = drawn.cube(*by, "_replicate").agg(F.grouping_id().alias("_level"), F.sum("_weight").alias("_n"), *sums).where("_level % 2 = 0")
    means = F.array(*(F.struct(F.lit(name).alias("metric"), (F.col(name) / F.col("_n")).alias("value")) for name in names))
    rows = each.select(*by, F.floor(F.col("_level") / 2).cast("long").alias("level"), F.explode(means).alias("m"))
    bound = lambda q: F.percentile(F.col("m.value"), F.lit(q))
    return rows.groupBy(*by, "level", F.col("m.metric").alias("metric")).agg(bound((1 - level) / 2).alias("low"), bound((1 + level) / 2).alias("high"))


def first_collections(ranks: DataFrame) -> DataFrame:
    """query_id, collection: where a gold document stands highest; ranks: query_id, collection, rank."""
    return ranks.where("rank IS NOT NULL").groupBy("query_id").agg(F.min_by("collection", F.struct("rank", "collection")).alias("collection"))


def with_stages(cases: DataFrame, ranks: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """A row for each case and stage, the rank null where the stage found nothing."""
    each = cases.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return each.join(ranks.select("query_id", "stage", "rank"), ["query_id", "stage"], "left")


# The ids of the small sample.
SAMPLE = ("Q01", "Q15", "Q27", "Q51", "Q02", "Q16", "Q28", "Q52", "Q23", "Q35", "Q47", "Q53")


def selected(cases: DataFrame, ids: list[str] | None = None, kind: str | None = None, sample: bool = False) -> DataFrame:
    """Cases by id, by class, and by the small sample; an unknown id raises ValueError, and so does a selection without cases."""
    if ids:
        known = {r[0] for r in cases.where(F.col("id").isin(ids)).select("id").collect()}
        if missing := sorted(set(ids) - known):
            raise ValueError(f"unknown cases: {missing}")
        cases = cases.where(F.col("id").isin(ids))
    if kind is not None:
        cases = cases.where(F.col("class") == kind)
    if sample:
        cases = cases.where(F.col("id").isin(*SAMPLE))
    if not cases.limit(1).count():
        raise ValueError("no cases are selected")
    return cases


def intent_passes(results: DataFrame) -> DataFrame:
    """passed, total: cases whose filters equal the expected ones; cases in error count in the total only. results: expected, actual (maps), error."""
    from ..functions.values import maps_equal

    same = F.col("error").isNull() & F.coalesce(maps_equal(F.col("expected"), F.col("actual")), F.lit(False))
    return results.agg(F.count_if(same).alias("passed"), F.count("*").alias("total"))
