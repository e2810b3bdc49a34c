"""Evaluation cases, runs and their files: validated readers, result sinks and the stage cache."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import COLLECTIONS

CASES = "id string, pair string, class string, stress string, query string, gold_doc_ids array<string>, expected_collections array<string>, pass_at int"
INTENT_CASES = "id string, query string, expected_filters map<string,string>"
RUNS = "run_name string, created_at string, parameters struct<skip_agentic:boolean,limit:int>, dataset_sha256 string, results array<struct<id:string,class:string,pass_at:int,ranks:map<string,int>,citation_valid:boolean>>"


def _require(df: DataFrame, condition, what: str) -> None:
    bad = [r[0] for r in df.where(condition).select(F.col("id")).limit(5).collect()]
    if bad:
        raise ValueError(f"{what}: {bad}")


def _unique(df: DataFrame) -> None:
    twice = df.groupBy("id").count().where("count > 1")
    _require(twice, F.lit(True), "an id that stands twice")


def validated(cases: DataFrame) -> DataFrame:
    """The cases, or ValueError: none at all, a key missing, an id twice, an unknown collection, an empty query or no gold."""
    if not cases.limit(1).count():
        raise ValueError("no cases")
    for key in ("id", "class", "query", "gold_doc_ids", "expected_collections", "pass_at"):
        _require(cases, F.col(key).isNull(), f"no {key}")
    _unique(cases)
    _require(cases, F.size(F.array_except("expected_collections", F.array(*map(F.lit, COLLECTIONS)))) > 0, "an unknown collection")
    _require(cases, (F.trim("query") == "") | (F.size("gold_doc_ids") == 0), "an empty query or no gold")
    return cases


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return validated(spark.read.schema(CASES).json(path, multiLine=True))


def load_intent_cases(spark: SparkSession, path: str) -> DataFrame:
    cases = spark.read.schema(INTENT_CASES).json(path, multiLine=True)
    if not cases.limit(1).count():
        raise ValueError("no cases")
    for key in ("id", "query", "expected_filters"):
        _require(cases, F.col(key).isNull(), f"no {key}")
    _unique(cases)
    return cases


def load_runs(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(RUNS).json(list(paths), multiLine=True)


def long_ranks(runs: DataFrame) -> DataFrame:
    """run, query_id, stage, rank, pass_at of runs in their file form."""
    results = runs.select(F.col("run_name").alias("run"), F.explode("results").alias("r"))
    return results.select("run", F.col("r.id").alias("query_id"), F.explode("r.ranks").alias("stage", "rank"), F.col("r.pass_at").alias("pass_at"))


def run_name(name: str, created_at: datetime) -> str:
    """A run's folder: the time in UTC, to the microsecond, and the name with all but letters, digits, _ and - made -."""
    slug = re.sub(r"[^a-zA-Z0-9_-]+", "-", name).strip("-") or "run"
    return f"{created_at.astimezone(timezone.utc):%Y%m%dT%H%M%S%f}Z-{slug}"


def _digest(df: DataFrame) -> str:
    """A digest of a table's rows: a sum of row hashes, so it does not depend on their order and needs no collect."""
    total = df.agg(F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("d")).first().d
    return hashlib.sha256(str(total).encode()).hexdigest()


def write_run(results: DataFrame, folder: str, run_name: str, parameters: dict, latest: bool = True, cases: DataFrame | None = None) -> str:
    """Write a run's results as JSON under folder/run=<name>, and its cases under folder/dataset=<name>; with ``latest`` also as the latest run.

    Returns a digest of the results. The digest of the cases stands in each result.
    """
    stamped = results.withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True)))
    if cases is not None:
        stamped = stamped.withColumn("dataset_sha256", F.lit(_digest(cases)))
    for name in (run_name, "latest") if latest else (run_name,):
        stamped.write.mode("overwrite").json(f"{folder}/run={name}")
        if cases is not None:
            cases.write.mode("overwrite").json(f"{folder}/dataset={name}")
    return _digest(stamped)


def cache_key(case_id: str, models: dict[str, str | None], parameters: dict) -> str:
    """A key of the case, the models and a hash of all parameters."""
    given = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]
    name = "_".join([case_id, *(f"{role}-{model or 'default'}" for role, model in sorted(models.items())), given])
    return "".join(c if c.isalnum() or c in "_-" else "-" for c in name).strip("-")


def cached_cases(path: str, stage: str, cases: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """The rows of a stage for cases (``key`` among their columns), of which only those that the cache lacks are made.

    The cache is one table partitioned by stage and key. ``make`` takes the missing cases and returns rows with the key; what it returns replaces the
    partitions of these keys alone (dynamic overwrite), so a run that is broken off leaves the others. A case without rows is remembered by a
    row of nulls with ``_there`` false. Reads name the stage, and the keys meet the partitions in a join that prunes them.
    """
    spark = cases.sparkSession
    wanted = cases.select(F.col(key).alias("cache_key")).distinct()

    def held() -> DataFrame | None:
        try:
            return spark.read.parquet(path).where(F.col("stage") == stage)
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing has been written yet
                return None
            raise

    there = held()
    known = wanted.limit(0) if there is None else there.select("cache_key").distinct()
    missing = cases.join(known.withColumnRenamed("cache_key", key), key, "left_anti")
    if not missing.isEmpty():
        made = make(missing)
        rows = made.withColumnRenamed(key, "cache_key").withColumn("_there", F.lit(True)).withColumn("stage", F.lit(stage))
        marks = missing.select(F.col(key).alias("cache_key")).distinct().withColumn("_there", F.lit(False)).withColumn("stage", F.lit(stage))
        both = rows.unionByName(marks, allowMissingColumns=True)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "cache_key").parquet(path)
        there = held()
    if there is None:  # no cases, and no cache
        made = make(cases.limit(0))
        return made.limit(0)
    columns = [c for c in there.columns if c not in ("stage", "_there")]
    return there.where("_there").join(F.broadcast(wanted) if wanted.limit(50_001).count() <= 50_000 else wanted, "cache_key", "left_semi").select(*columns).withColumnRenamed("cache_key", key)


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The stage table under the key; made and written first if it is not there."""
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
