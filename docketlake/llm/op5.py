"""Query op5: links between near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard
from ._common import documents


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir).select("doc_id", "text"))
