"""Batches of requests in, messages out: instant search, answers and the agent, with the trace of their steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import rank
from ..storage import kept
from ..streaming import trace
from . import modes
from .models import Models, embedded
from .retrieval import Corpus

MODES = ("instant", "ai_mode", "both")
MESSAGE = ("query_id", "seq", "type", "step", "data")


def paths(mode: Column) -> Column:
    """The ways that a mode takes; a missing mode takes both, an unknown one none."""
    mode = F.coalesce(mode, F.lit("both"))
    return F.filter(F.array(F.lit("instant"), F.lit("ai_mode")), lambda p: (mode == "both") | (mode == p))


def _listed(hits: DataFrame, name: str, *more: str) -> DataFrame:
    """query_id and one list of a query's hits in order."""
    row = F.struct("pos", *(c for c in ("doc_id", "score", *more) if c in hits.columns))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias(name))


def _terminal(rows: DataFrame, type_: str, ord_: int, data: Column) -> DataFrame:
    return rows.select("query_id", F.lit(ord_).alias("ord"), F.lit(type_).alias("type"), F.lit(None).cast("string").alias("step"), data.alias("data"))


HITS = {
    "es": "query_id string, pos int, doc_id string, score double, heading string, subheading string",
    "dense": "query_id string, collection string, collection_ord int, pos int, chunk_id string, doc_id string, text string, score double",
}
HITS["sparse"] = HITS["dense"]


def read(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that can be answered, messages of the others) of requests (query_id, query and, if they have them, mode, trace, rerank).

    A missing mode is both, missing flags are false. A query that is null or blank, or a mode that does not exist, ends with an error.
    """
    have = set(requests.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    mode = F.coalesce(F.col("mode"), F.lit("both")) if "mode" in have else F.lit("both")
    given = requests.select("query_id", "query", mode.alias("mode"), flag("trace").alias("trace"), flag("rerank").alias("rerank"))
    problem = F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "no query").when(~F.col("mode").isin(*MODES), F.concat(F.lit("unknown mode: "), "mode"))
    marked = given.withColumn("_problem", problem)
    bad = marked.where("_problem IS NOT NULL")
    messages = bad.select("query_id", F.lit(1).alias("seq"), F.lit("ai_mode_error").alias("type"), F.lit(None).cast("string").alias("step"), F.to_json(F.struct(F.col("_problem").alias("error"))).alias("data"))
    return marked.where("_problem IS NULL").drop("_problem"), messages


def _found(corpus: Corpus, queries: DataFrame, vectors: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(hits of each branch, written once; errors of branches whose plan or index is at fault). Other faults are the cluster's and fail the batch, which is then tried again."""
    found, errors = {}, {}
    for name, make in modes.branches(corpus, queries, vectors).items():
        try:
            if name == "dense" and corpus.vectors is None:
                raise ValueError("no vectors")
            found[name] = checkpoint(make())
        except (AnalysisException, ValueError) as problem:
            errors[name] = f"{type(problem).__name__}: {problem}".splitlines()[0]
            found[name] = queries.sparkSession.createDataFrame([], HITS[name])
    return found, errors


def search(requests: DataFrame, corpus: Corpus, models: Models, checkpoint: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """query_id, seq, type, step, data (JSON) of requests (query_id, query, mode, trace, rerank): the frames of those that ask for a trace, then their results.

    Instant search ends with ``instant_result``, an answer with ``ai_mode_done`` or ``ai_mode_error``; with both, they come in this order. The hits
    are written once, and frames and results are made from them. A branch that is at fault is told in its result and leaves the others; requests
    that cannot be answered end with an error.
    """
    good, refused = read(requests)
    ways = checkpoint(good.withColumn("_ways", paths(F.col("mode"))))
    of = lambda way: ways.where(F.array_contains("_ways", way)).select("query_id", "query", "rerank")
    steps: list[tuple[str, DataFrame]] = []
    on_step = lambda step, frames: steps.append((step, frames))
    ends = None

    quick = of("instant")
    if not quick.isEmpty():
        vectors = checkpoint(embedded(quick.select("query_id", "query"), "query", models).where("vector IS NOT NULL").select("query_id", "vector"))
        found, errors = _found(corpus, quick.select("query_id", "query"), vectors, checkpoint)
        modes.told_instant(found, on_step)
        lists = [("es", found["es"]), ("dense", rank.flattened(found["dense"], ["query_id"])), ("sparse", rank.flattened(found["sparse"], ["query_id"]))]
        asked = quick.where("rerank").select("query_id", "query")
        if not asked.isEmpty():
            best = checkpoint(modes.instant_reranked(found, corpus.index, asked, models))
            on_step("instant_reranked", trace.ranked(best.withColumnRenamed("rank", "pos").withColumnRenamed("rerank_score", "score")))
            lists.append(("reranked", best.select("query_id", F.col("rank").alias("pos"), "doc_id", F.col("rerank_score").alias("score"))))
        result = quick.select("query_id")
        for name, hits in lists:
            result = result.join(_listed(hits, name, "collection", "chunk_id", "heading", "subheading"), "query_id", "left")
        told = [F.lit(errors.get("es")).cast("string").alias("es_error"), F.lit("; ".join(e for n, e in errors.items() if n != "es") or None).cast("string").alias("milvus_error")]
        ends = _terminal(result, "instant_result", 1000, F.to_json(F.struct(*(name for name, _ in lists), *told)))

    read_ = of("ai_mode").select("query_id", "query")
    if not read_.isEmpty():
        answers = checkpoint(modes.ai_mode(corpus, read_, models, checkpoint, on_step=on_step))
        done = _terminal(answers.where("ok"), "ai_mode_done", 1001, F.to_json(F.struct("answer", "reasoning", "citations")))
        done = done.unionByName(_terminal(answers.where("NOT ok"), "ai_mode_error", 1001, F.to_json(F.struct(F.coalesce("error", F.lit("no answer")).alias("error")))))
        ends = done if ends is None else ends.unionByName(done)
    if ends is None:
        return refused.select(*MESSAGE)
    frames = trace.of_steps(steps).join(ways.where("trace").select("query_id"), "query_id", "left_semi")
    return trace.numbered(frames.unionByName(ends), ["query_id"], [F.col("ord"), F.col("data")]).select(*MESSAGE).unionByName(refused.select(*MESSAGE))


def agent(requests: DataFrame, models: Models, tools: dict, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, seq, type, step, data of requests (query_id, query): the agent's steps, then ``agent_done`` or ``agent_unverifiable``."""
    steps: list[tuple[str, DataFrame]] = []
    done = modes.agent(requests.select("query_id", "query"), models, tools, checkpoint, on_step=lambda step, frames: steps.append((step, frames)))
    ends = _terminal(done.where("status = 'answer'"), "agent_done", 1000, F.to_json(F.struct("answer", "doc_ids")))
    ends = ends.unionByName(_terminal(done.where("status <> 'answer'"), "agent_unverifiable", 1000, F.to_json(F.struct("invalid_doc_ids"))))
    frames = trace.of_steps(steps)
    return trace.numbered(ends if frames is None else frames.unionByName(ends), ["query_id"], [F.col("ord"), F.col("data")]).select(*MESSAGE)


def serve(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A stream of requests answered batch by batch into a table.

    What is wrong with a request, a model's reply or a branch is a message of the answer. Any other fault fails the batch, so that the stream tries it again
    from its checkpoint; a batch that is run again replaces its own rows.
    """

    def batch(requests: DataFrame, number: int) -> None:
        answer(requests).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def documents(ids: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, found, heading, subheading, year, blocks of the documents asked for; what does not parse is shown without its tags."""
    year = F.col("year.name") if dict(index.dtypes)["year"].startswith("struct") else F.col("year")
    held = index.select(F.col("id").alias("doc_id"), F.lit(True).alias("found"), "heading", "subheading", year.alias("year"), markup.blocks(F.col("fullcontent")).alias("blocks"))
    return ids.select("doc_id").join(held, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
