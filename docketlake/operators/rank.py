"""Ranking: top-k, elbow cutoff, distinct-document ranks, pages and previews.

Every ranking ends with a unique key. Windows are partitioned by query (and list), never global, and a filter on the
row number stands right above each, so that Spark limits the groups before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO, MIN_KEEP = 0.6, 1


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Append the 1-based position within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).where(F.col(name) <= n)


def elbow(df: DataFrame, by: list[str], score: str = "score", ties: list[Column] = (), min_keep: int = MIN_KEEP, max_keep: int | None = None, ratio: float = RATIO) -> DataFrame:
    """Keep each list, by falling score, up to the first score under ``ratio`` times the one before it; appends rank.

    The first ``min_keep`` rows always stay; at most ``max_keep`` do.
    """
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    placed = df.withColumn("rank", F.row_number().over(window)).withColumn("_before", F.lag(score).over(window))
    falls = (F.col("rank") > min_keep) & (F.col(score) < ratio * F.col("_before"))
    placed = placed.withColumn("_breaks", F.sum(falls.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    kept = placed.where(F.coalesce("_breaks", F.lit(0)) == 0)
    if max_keep is not None:
        kept = kept.where(F.col("rank") <= max_keep)
    return kept.drop("_before", "_breaks")


def cutoff_counts(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """by, before, after: how many hits lists have before and after their cutoff; a list of which nothing is left counts 0."""
    left = after.groupBy(*by).agg(F.count("*").alias("after"))
    return before.groupBy(*by).agg(F.count("*").alias("before")).join(left, by, "left").withColumn("after", F.coalesce("after", F.lit(0)))


def document_ranks(hits: DataFrame, by: list[str], pos: str = "pos", doc: str = "doc_id") -> DataFrame:
    """by, doc, doc_rank: the rank of each document among the distinct documents of a list, by first occurrence."""
    first = hits.groupBy(*by, doc).agg(F.min(pos).alias("_first"))
    return ranked(first, by, [F.col("_first"), F.col(doc)], "doc_rank").drop("_first")


def gold_rank(hits: DataFrame, gold: DataFrame, by: list[str], pos: str = "pos", doc: str = "doc_id") -> DataFrame:
    """Best rank of a gold document in each list that holds one; gold: query_id, doc_id. Lists without one have no row."""
    return document_ranks(hits, by, pos, doc).join(gold.select("query_id", doc).distinct(), ["query_id", doc]).groupBy(*by).agg(F.min("doc_rank").alias("rank"))


def flattened(hits: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Lists of all collections in one by falling raw score; ties by collection order, then position. Appends flat_pos."""
    return ranked(hits, by, [F.col(score).desc(), F.col("collection_ord"), F.col("pos")], "flat_pos")


def paged(df: DataFrame, by: list[str], pos: str, size: int = 10) -> DataFrame:
    """Append page, from 1."""
    return df.withColumn("page", (F.floor((F.col(pos) - 1) / size) + 1).cast("int"))


def page(df: DataFrame, by: list[str], pos: str, wanted: Column, size: int = 10) -> DataFrame:
    """Rows of the wanted page; a page past the end is the last one, one before the start the first."""
    pages = F.max("page").over(Window.partitionBy(*by))
    numbered = paged(df, by, pos, size).withColumn("_pages", pages)
    return numbered.where(F.col("page") == F.greatest(F.lit(1), F.least(wanted, F.col("_pages")))).drop("_pages")


def first_unique(df: DataFrame, by: list[str], order: list[Column], n: int, doc: str = "doc_id") -> DataFrame:
    """The first row of each document, for the first ``n`` documents; appends doc_pos. Documents come in the order of their first rows."""
    placed = ranked(df, by, order, "_pos")
    own = ranked(placed, [*by, doc], [F.col("_pos")], "_own").where("_own = 1")
    return top(own, by, [F.col("_pos")], n, "doc_pos").drop("_pos", "_own")


def shown_first(items: Column, n: int = 5) -> Column:
    """struct(first, more): the first n items and how many follow."""
    return F.struct(F.slice(items, 1, n).alias("first"), F.greatest(F.size(items) - n, F.lit(0)).alias("more"))
