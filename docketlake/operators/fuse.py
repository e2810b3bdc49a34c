"""Fusion of ranked lists and merging of result cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import ranked

K = 60
# Weights of the lists by intent and by query shape.
INTENT_WEIGHTS = {"citation_lookup": (0.5, 1.5), "provision_lookup": (0.5, 1.5), "conceptual": (1.5, 0.5), "unknown": (1.0, 1.0)}
SHAPE_WEIGHTS = {"citation": (1.5, 0.5, 1.5), "provision": (1.5, 0.5, 1.5), "plain": (1.0, 1.5, 0.5)}


def intent_weight(intent: Column, source: Column, enabled: bool = True) -> Column:
    """Weight of the dense or sparse list; 1 for an intent that is not listed, and for all when weighting is off."""
    out = F.lit(1.0)
    if enabled:
        for name, (dense, sparse) in INTENT_WEIGHTS.items():
            out = F.when(intent == name, F.when(source == "dense", F.lit(dense)).otherwise(F.lit(sparse))).otherwise(out)
    return out


def shape_weight(shape: Column, source: Column) -> Column:
    """Weight of the full-text, dense or sparse list by the query's shape; 1 for others."""
    out = F.lit(1.0)
    for name, (es, dense, sparse) in SHAPE_WEIGHTS.items():
        out = F.when(shape == name, F.when(source == "es", F.lit(es)).when(source == "dense", F.lit(dense)).when(source == "sparse", F.lit(sparse)).otherwise(F.lit(1.0))).otherwise(out)
    return out


def collapsed(hits: DataFrame, by: list[str], pos: str = "pos", doc: str = "doc_id") -> DataFrame:
    """The first row of each document of a list, with positions counted anew."""
    first = ranked(hits, [*by, doc], [F.col(pos)], "_own").where("_own = 1").drop("_own")
    return ranked(first, by, [F.col(pos)], "_new").drop(pos).withColumnRenamed("_new", pos)


def reciprocal(hits: DataFrame, key: str, weight: Column | None = None, k: int = K, places: int = 9) -> DataFrame:
    """query_id, key, rrf_score, src_ord, pos and the payload of the first list that has the key.

    hits: query_id, src_ord, pos (1-based), key and payload. A score is the sum of weight / (k + pos); a key that one list
    repeats adds each time. Ties are in the order of first insertion: list, then position. Rows of a key are summed after partial aggregation, so one
    shuffle by (query, key) does.
    """
    payload = [c for c in hits.columns if c not in ("query_id", key, "weight")]
    share = (F.lit(1.0) if weight is None else weight) / (k + F.col("pos"))
    first = F.min(F.struct("src_ord", "pos", *(c for c in payload if c not in ("src_ord", "pos")))).alias("_first")
    fused = hits.withColumn("_share", share).groupBy("query_id", key).agg(F.round(F.sum("_share"), places).alias("rrf_score"), first)
    return fused.select("query_id", key, "rrf_score", "_first.*")


def fused_rank(fused: DataFrame) -> DataFrame:
    return ranked(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("src_ord"), F.col("pos")], "fused_pos")


def best_per_document(hits: DataFrame, by: list[str]) -> DataFrame:
    """Per document the row with the largest score, the earlier of equals; hits have flat_first (position over all lists). Appends first_seen."""
    best = hits.groupBy(*by, "doc_id").agg(
        F.min("flat_first").alias("first_seen"),
        F.max_by(F.struct("score", "collection", "text"), F.struct("score", (-F.col("flat_first")).alias("p"))).alias("b"),
    )
    return best.select(*by, "doc_id", "first_seen", "b.*")


def cards(es: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, card_pos, source, doc_id, score, collection, snippet, heading.

    Full-text cards in their order, once for each document; then dense and then sparse cards of documents that full text did not find,
    the best row of each document, in the order in which documents were first seen.
    """
    text = collapsed(es, ["query_id"]).select("query_id", F.lit(0).alias("segment"), F.col("pos").cast("long").alias("at"), F.lit("es").alias("source"), "doc_id", "score", F.lit(None).cast("string").alias("collection"), F.col("subheading").alias("snippet"), "heading")
    parts = text
    for segment, (name, hits) in enumerate((("milvus_dense", dense), ("milvus_sparse", sparse)), 1):
        rest = best_per_document(hits.join(text.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), ["query_id"])
        parts = parts.unionByName(rest.select("query_id", F.lit(segment).alias("segment"), F.col("first_seen").cast("long").alias("at"), F.lit(name).alias("source"), "doc_id", "score", "collection", F.col("text").alias("snippet"), F.lit(None).cast("string").alias("heading")))
    return ranked(parts, ["query_id"], [F.col("segment"), F.col("at")], "card_pos").drop("segment", "at")


def reranked_cards(hits: DataFrame) -> DataFrame:
    """Cards of reranked rows: the snippet is the subheading, else the text, else empty."""
    return hits.select("query_id", "doc_id", F.lit("reranked").alias("source"), F.col("rerank_score").alias("score"), "heading", F.coalesce("subheading", "text", F.lit("")).alias("snippet"))


def of_sources(cards: DataFrame, sources: list[str], developer: bool, reranked: bool) -> DataFrame:
    """The cards of the chosen sources; only developers choose, and reranked cards have one source."""
    return cards.where(F.col("source").isin(sources)) if developer and not reranked else cards
