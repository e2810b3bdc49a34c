"""Query op2: mix all documents so that sources share one and a half times all words by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mixing
from ._common import checkpoint, documents

#: Weights of the sources in the order of their names, repeating, and the words wanted as a share of those there.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2


def targets_of(sized: DataFrame) -> DataFrame:
    """source, size, weight, target; names in the order of their code points, null last. One row per source."""
    sources = checkpoint(sized.groupBy("source").agg(F.sum("size").cast("long").alias("size")))
    # one row per source reaches this window, never documents
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(order, F.lit(len(WEIGHTS))) + 1)
    sources = checkpoint(sources.select("source", "size", weight.alias("weight")))
    total = float(sources.agg(F.sum("size").alias("t")).first().t or 0)
    return mixing.water_fill(sources, SHARE * total, MOST)


def mixed(docs: DataFrame) -> DataFrame:
    sized = docs.withColumn("size", mixing.size_of(F.col("text")))
    return mixing.mix(sized, targets_of(sized), most=MOST)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = checkpoint(documents(spark, sf_dir).select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")))
    return mixing.mix(sized, targets_of(sized), most=MOST).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
