"""An evaluation run: every case through every stage as one batch, its summary, and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import values as V
from ..operators import evaluate, rank
from . import modes, retrieval
from .models import Models
from .retrieval import Corpus


def flat(hits: DataFrame) -> DataFrame:
    return rank.flattened(hits, ["query_id"]).withColumn("pos", F.col("flat_pos"))


def stages(corpus: Corpus, queries: DataFrame, vectors: DataFrame, models: Models, limit: int = 50, checkpoint=None, searches: retrieval.Searches | None = None) -> dict[str, DataFrame]:
    """Ranked rows (query_id, pos, doc_id and more) of each stage; vectors are those of the queries as asked.

    ``searches`` of both limits are those that other steps of the run share.

    The rewritten query is embedded and searched, within the allowlist of its filters, by the same steps as answers are. A stage is a plan of its own;
    but the sparse hits of queries as asked and as rewritten come from one search, and ``checkpoint`` writes lists that are used again, so that plans stay small.
    """
    kept = checkpoint or (lambda df: df)
    searches = searches or retrieval.Searches(corpus, limit, limit)
    read = kept(modes.intents(queries, models))
    lists, new = modes.allowed(corpus.index, read, written=corpus.fields), searches.sparse.new(queries)
    raw, sparse = retrieval.sparse_batches(corpus.chunks, [(new.select(F.col("query").alias("query_id"), "query"), None), (modes.rewritten(read), lists)], limit, corpus.words)
    searches.sparse.learn(new, raw)
    dense, sparse, fused = modes.retrieved(corpus, read, models, lists, limit, sparse=sparse, checkpoint=checkpoint)
    reranked = modes.context(fused, queries, models, keep=None, cut=False)
    return {
        "es": searches.full_text(queries),
        "raw_dense": flat(kept(retrieval.dense_hits(corpus.vectors, vectors, limit))),
        "raw_sparse": flat(searches.sparse(queries)),
        "rewritten_dense": flat(dense),
        "rewritten_sparse": flat(sparse),
        "rrf": fused.drop("pos").withColumnRenamed("fused_pos", "pos"),
        "reranker": reranked.withColumnRenamed("rank", "pos"),
    }


def agentic(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank: 1 where an agent's answer (query_id, doc_ids) cites a gold document; gold: query_id, doc_id."""
    cited = answers.select("query_id", F.explode("doc_ids").alias("doc_id")).join(gold, ["query_id", "doc_id"], "left_semi")
    return cited.select("query_id").distinct().withColumn("rank", F.lit(1))


def ranks(found: dict[str, DataFrame], cases: DataFrame, gold: DataFrame, run: str, answers: DataFrame | None = None) -> DataFrame:
    """run, query_id, class, pass_at, stage, rank (null: no gold document found) for every case and stage; with an agent's answers its stage too."""
    parts = [rank.gold_rank(hits, gold, ["query_id"]).select("query_id", F.lit(name).alias("stage"), "rank") for name, hits in found.items()]
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    names = tuple(found)
    if answers is not None:
        held, names = held.unionByName(agentic(answers, gold).select("query_id", F.lit("agentic").alias("stage"), "rank")), (*names, "agentic")
    every = evaluate.with_stages(cases.select("query_id", "class", "pass_at"), held, names)
    return every.withColumn("run", F.lit(run)).select("run", "query_id", "class", "pass_at", "stage", "rank")


def collection_ranks(found: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """query_id, stage, collection, rank of the gold document in each collection of the stages that search collections."""
    out = None
    for name in ("raw_dense", "raw_sparse", "rewritten_dense", "rewritten_sparse"):
        part = rank.gold_rank(found[name], gold, ["query_id", "collection"]).select("query_id", F.lit(name).alias("stage"), "collection", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def citation_flags(best: DataFrame, queries: DataFrame, gold: DataFrame, models: Models) -> DataFrame:
    """query_id, citation_count, invalid, citation_valid, gold_cited of the answers that a model writes from the best chunks."""
    answers = modes.synthesised(best, queries, models).select("query_id", "answer")
    seen = best.groupBy("query_id").agg(F.collect_set("doc_id").alias("seen"))
    right = gold.groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    joined = answers.join(seen, "query_id", "left").join(right, "query_id", "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("seen", F.coalesce("seen", none))
    return joined.select("query_id", F.size(C.cited_ids(F.col("answer"))).alias("citation_count"), C.invalid_ids(F.col("answer"), F.col("seen")).alias("invalid"), C.citation_valid(F.col("answer"), F.col("seen")).alias("citation_valid"), C.gold_cited(F.col("answer"), F.coalesce("gold", none)).alias("gold_cited"))


def errors_and_times(steps: DataFrame) -> DataFrame:
    """query_id, errors (step to message), times (step to ms, one decimal); steps: query_id, step, error, ms."""
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(key), V.rounded_ms(F.col(value)).alias("v") if value == "ms" else F.col(value).alias("v"))))))
    return steps.groupBy("query_id").agg(pairs("step", "error").alias("errors"), pairs("step", "ms").alias("times"))


def summary(results: DataFrame) -> DataFrame:
    """stage, shown: passed of total for a reader."""
    rates = evaluate.pass_rates(results)
    return rates.select("run", "stage", F.format_string("%d/%d", "passed", "total").alias("shown"))


def shown_comparison(rates: DataFrame, baseline: str, flags: DataFrame) -> DataFrame:
    """run, stage, shown: passed and the signed difference to the baseline, N/A where the runs don't compare."""
    table = evaluate.comparison(rates, baseline, flags)
    return table.select("run", "stage", F.concat_ws(" ", F.format_string("%d/%d", "passed", "total"), V.shown_delta(F.col("delta"), F.col("comparable"))).alias("shown"))
