"""Query op8: the quality score of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from ._common import documents

#: Scores from which a document counts as good.
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept out of learning: crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(docs: DataFrame, sf_dir: str) -> quality.Model:
    labels = docs.sparkSession.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.train(docs, labels, lambda k: ~held_out(k))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality.score(docs, fitted(docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
