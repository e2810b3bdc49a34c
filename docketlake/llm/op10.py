"""Query op10: documents without the passages that an earlier document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spans
from ._common import documents


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "removed_units", "text")
