"""The three ways to answer a batch of queries: instant search, answers with citations, and the agent loop."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import filters as P
from ..operators import fuse, rank
from ..operators.postings import Index
from ..operators.score import small
from ..storage import kept
from ..streaming import trace
from . import retrieval
from .models import Models, Tool, answered, embedded, reranked
from .retrieval import Allowed, Corpus

log = logging.getLogger(__name__)

INTENTS = ("citation_lookup", "provision_lookup", "conceptual", "unknown")
REPLY = "rewritten_query string, intent string, filters map<string,string>"
ROUNDS, ATTEMPTS = 8, 3
#: What a caller may pass to see the steps: their name and frames (query_id, data as JSON).
OnStep = Callable[[str, DataFrame], None]
# Paths of the citation metadata in a document.
CITATION_PATHS = {
    "heading": "heading",
    "subheading": "subheading",
    "citations": "masterinfo.citations",
    "court": "masterinfo.info.court",
    "bench": "masterinfo.info.bench",
    "judge": "otherinfo.judge",
    "partyname": "otherinfo.partyname",
}


def emit(on_step: OnStep | None, step: str, frames: Callable[[], DataFrame]) -> None:
    """Tell the caller of a step; an error of the caller's is dropped, as a dead listener must not fail the answer."""
    if on_step is not None:
        try:
            on_step(step, frames())
        except Exception:  # noqa: BLE001
            log.debug("step %s dropped", step, exc_info=True)


def _data(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items()))).alias("data")


def branches(corpus: Corpus, queries: DataFrame, vectors: DataFrame, loose: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """How to make the es, dense and sparse hits of each query after their cutoffs; each is a plan of its own."""
    by = ["query_id", "collection"]
    ties = [F.col("chunk_id")]
    renumber = lambda df: df.drop("pos").withColumnRenamed("rank", "pos")
    return {
        "es": lambda: renumber(rank.elbow(retrieval.full_text(corpus.index, queries, loose=loose, written=corpus.fields), ["query_id"], ties=[F.col("doc_id")])),
        "dense": lambda: renumber(rank.elbow(retrieval.dense_hits(corpus.vectors, vectors), by, ties=ties)),
        "sparse": lambda: renumber(rank.elbow(retrieval.sparse_hits(corpus.chunks, queries, written=corpus.words), by, ties=ties)),
    }


def instant(corpus: Corpus, queries: DataFrame, vectors: DataFrame, loose: bool = False, on_step: OnStep | None = None) -> dict[str, DataFrame]:
    """es, dense and sparse hits of each query after their cutoffs: the branches are plans of their own, so one that fails leaves the others.

    ``loose``: terms of the full-text search allow edits.
    """
    found = {name: make() for name, make in branches(corpus, queries, vectors, loose).items()}
    told_instant(found, on_step)
    return found


def told_instant(found: dict[str, DataFrame], on_step: OnStep | None) -> None:
    """The frames of the branches."""
    emit(on_step, "es_search", lambda: trace.ranked(found["es"]))
    for name in ("dense", "sparse"):
        emit(on_step, f"milvus_{name}", lambda name=name: trace.per_collection(found[name]))


def instant_reranked(branches: dict[str, DataFrame], index: DataFrame, queries: DataFrame, models: Models, limit: int = 20, on_step: OnStep | None = None) -> DataFrame:
    """query_id, rank, doc_id, rerank_score: the lists after their cutoffs, fused by document, reranked on full texts and cut off.

    Candidates without a full text go; a query without candidates has no row and calls no model.
    """
    flat = [branches["es"].select("query_id", F.lit("es").alias("source"), F.lit(0).alias("src_ord"), "pos", "doc_id")]
    for i, name in enumerate(("dense", "sparse"), 1):
        flat.append(rank.flattened(branches[name], ["query_id"]).select("query_id", F.lit(name).alias("source"), F.lit(i).alias("src_ord"), F.col("flat_pos").alias("pos"), "doc_id"))
    hits = fuse.collapsed(flat[0].unionByName(flat[1]).unionByName(flat[2]), ["query_id", "source"])
    hits = hits.join(small(queries.select("query_id", T.query_shape(F.col("query")).alias("shape"))), "query_id").withColumn("weight", fuse.shape_weight(F.col("shape"), F.col("source"))).drop("shape")
    best = fuse.fused_rank(fuse.reciprocal(hits, "doc_id", F.col("weight"))).where(F.col("fused_pos") <= limit)
    texts = index.where(F.length("fullcontent") > 0).select(F.col("id").alias("doc_id"), "fullcontent")
    rows = best.join(texts, "doc_id").join(small(queries.select("query_id", "query")), "query_id")
    scored = reranked(rows, "query", "fullcontent", models).drop("fullcontent", "query")
    out = rank.elbow(scored, ["query_id"], "rerank_score", [F.col("fused_pos")]).select("query_id", "rank", "doc_id", "rerank_score")
    emit(on_step, "instant_reranked", lambda: trace.ranked(out.withColumnRenamed("rank", "pos").withColumnRenamed("rerank_score", "score")))
    return out


#: What the collections hold, as a model that reads queries is told.
COLLECTIONS = {
    "case_summary": "summaries of cases",
    "digest": "digests of rulings",
    "headnotes": "head notes",
    "facts": "facts of cases",
    "held": "what was held",
    "ruling": "texts of rulings",
    "metadata": "citations, courts and parties",
}


def intents(queries: DataFrame, models: Models, system: str | None = None, on_step: OnStep | None = None) -> DataFrame:
    """query_id, query, rewritten_query, intent, filters, dates: a model's reading of each query, kept to what the query itself holds.

    ``system`` is what the model is told first, ``reading_prompt`` over the collections if it is not given.

    A reply that is not JSON of the asked shape, or an error, leaves the query as it is, with an unknown intent and no filters.
    """
    told = reading_prompt(getattr(models, "reader", ""), COLLECTIONS)[0] if system is None else system
    message = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(told).alias("content")), F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))))
    replies = answered(queries.withColumn("_messages", message), "_messages", models).drop("_messages")
    parsed = replies.withColumn("_r", F.from_json(F.get_json_object("reply", "$.content"), REPLY)).drop("reply")
    out = parsed.select(*queries.columns, *read_reply(F.col("query"), F.col("_r")))
    emit(on_step, "intent", lambda: out.select("query_id", _data(query=F.col("query"), rewritten_query=F.col("rewritten_query"), intent=F.col("intent"), filters=F.col("filters"), dates=F.col("dates"))))
    return out


def read_reply(query: Column, reply: Column) -> tuple[Column, Column, Column, Column]:
    """(rewritten_query, intent, filters, dates) of a parsed reply; dates are the bounds gte and lte."""
    good = reply.isNotNull() & (F.trim(F.coalesce(reply["rewritten_query"], F.lit(""))) != "") & reply["intent"].isNotNull()
    empty = F.create_map().cast("map<string,string>")
    return (
        F.when(good, T.safe_rewrite(query, F.trim(reply["rewritten_query"]))).otherwise(query).alias("rewritten_query"),
        F.when(good & reply["intent"].isin(*INTENTS), reply["intent"]).otherwise("unknown").alias("intent"),
        F.when(good & reply["filters"].isNotNull(), P.sanitised(query, reply["filters"])).otherwise(empty).alias("filters"),
        F.when(good, F.coalesce(P.sanitised_dates(query, P.read_dates(reply["filters"])), empty)).otherwise(empty).alias("dates"),
    )


def allowed(index: DataFrame, read: DataFrame, on_step: OnStep | None = None, written: Index | None = None, most: int | None = P.MOST) -> Allowed:
    """The allowlists of queries that have been read, of ``most`` documents each (all that match if it is None); ``written`` is the index of the fields."""
    documents = kept(P.allowlists(index, P.requests_of(read), most, written))
    out = Allowed(documents, P.modes_of(read, documents))
    first = rank.top(documents, ["query_id"], [F.col("doc_id")], 10).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("s"))
    counts = documents.groupBy("query_id").agg(F.count("*").alias("n")).join(first, "query_id")
    emit(on_step, "filters_resolved", lambda: read.join(counts, "query_id", "left").select("query_id", _data(filters=F.col("filters"), doc_id_count=F.coalesce("n", F.lit(0)), doc_id_sample=F.coalesce("s", F.array().cast("array<string>")))))
    return out


def rewritten(read: DataFrame) -> DataFrame:
    """query_id, query of the rewritten queries."""
    return read.select("query_id", F.col("rewritten_query").alias("query"))


def retrieved(corpus: Corpus, read: DataFrame, models: Models, lists: Allowed | None = None, limit: int = retrieval.LIMIT, weighting: bool = True, on_step: OnStep | None = None, sparse: DataFrame | None = None, checkpoint=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dense, sparse, fused) of the rewritten queries within the allowlists; a query whose text cannot be embedded has no dense hits. ``sparse`` hits may be at hand."""
    held = checkpoint or (lambda df: df)
    vectors = embedded(read.select("query_id", "rewritten_query"), "rewritten_query", models).where("vector IS NOT NULL").select("query_id", "vector")
    dense = held(retrieval.dense_hits(corpus.vectors, vectors, limit, lists))
    if sparse is None:
        sparse = retrieval.sparse_hits(corpus.chunks, rewritten(read), limit, lists, corpus.words)
    fused = held(retrieval.fused_chunks(dense, sparse, read.select("query_id", "intent"), weighting))
    emit(on_step, "milvus_dense", lambda: trace.per_collection(dense))
    emit(on_step, "milvus_sparse", lambda: trace.per_collection(sparse))
    emit(on_step, "rrf_merge", lambda: trace.merged(fused))
    return dense, sparse, fused


def context(candidates: DataFrame, queries: DataFrame, models: Models, keep: int | None = 5, cut: bool = True, on_step: OnStep | None = None) -> DataFrame:
    """query_id, rank, chunk_id, doc_id, text, rerank_score: reranked by the query as asked, cut off (unless ``cut`` is False), five at most."""
    scored = reranked(candidates.join(small(queries.select("query_id", "query")), "query_id"), "query", "text", models)
    placed = rank.elbow(scored, ["query_id"], "rerank_score", [F.col("fused_pos")], max_keep=keep) if cut else rank.ranked(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("fused_pos")])
    out = placed.select("query_id", "rank", "chunk_id", "doc_id", "text", "rerank_score")
    emit(on_step, "rerank", lambda: trace.ranked(out.select("query_id", F.col("rank").alias("pos"), "doc_id", F.col("rerank_score").alias("score"))))
    return out


def reading_prompt(model: str, collections: dict[str, str]) -> tuple[str, bool]:
    """(what the model that reads queries is told, whether the wording was tuned for that model's family)."""
    told = T.schema_context(collections, [k for k in P.KEYS])
    lines = (
        "Read a legal research query. Reply with one JSON object: rewritten_query, intent, filters.",
        f"intent is one of {', '.join(INTENTS)}.",
        "filters holds only what the query itself says, word for word; date_range is an object with gte and lte as ISO dates.",
        "Add no act, court or number that the query lacks, and keep all of its identifiers.",
    )
    return "\n".join((*lines, told)), "llama" in model.lower()


def prompts(chunks: DataFrame, queries: DataFrame, every: bool = False) -> DataFrame:
    """query_id, prompt: the question and its excerpts in order; with ``every`` also for queries without excerpts."""
    parts = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "doc_id", F.lit("] "), "text").alias("t")))).alias("p"))
    body = F.coalesce(F.array_join(F.col("p.t"), "\n\n"), F.lit(""))
    return queries.join(parts, "query_id", "left" if every else "inner").select("query_id", F.concat(F.lit("Question: "), "query", F.lit("\n\nRelevant excerpts:\n"), body).alias("prompt"))


def citation_metadata(index: DataFrame) -> DataFrame:
    """doc_id and the seven paths of a document's citation metadata; no other column is read."""
    return index.select(F.col("id").alias("doc_id"), *(F.col(path).alias(name) for name, path in CITATION_PATHS.items()))


def prefetched(candidates: DataFrame, index: DataFrame, n: int = 20) -> DataFrame:
    """query_id, doc_id and citation metadata of the first ``n`` documents among the candidates."""
    first = rank.first_unique(candidates, ["query_id"], [F.col("fused_pos")], n).select("query_id", "doc_id")
    return first.join(citation_metadata(index), "doc_id")


def with_missing(fetched: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """fetched, and the metadata of the chunks' documents that are not among it."""
    missing = chunks.select("query_id", "doc_id").distinct().join(fetched.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return fetched.unionByName(missing.join(citation_metadata(index), "doc_id"))


def synthesised(best: DataFrame, queries: DataFrame, models: Models, system: str = "", on_step: OnStep | None = None) -> DataFrame:
    """query_id, prompt, answer, reasoning, error: a model's answer to each query from its excerpts."""
    asked = prompts(best, queries, every=True)
    emit(on_step, "synthesis_prompt", lambda: asked.select("query_id", _data(prompt=F.col("prompt"))))
    message = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
    replies = answered(asked.withColumn("_m", message), "_m", models)
    part = lambda name: F.get_json_object("reply", f"$.{name}").alias(name)
    return replies.select("query_id", "prompt", F.get_json_object("reply", "$.content").alias("answer"), part("reasoning"), part("error"))


def ai_mode(corpus: Corpus, queries: DataFrame, models: Models, checkpoint=None, weighting: bool = True, on_step: OnStep | None = None) -> DataFrame:
    """query_id, ok, answer, reasoning, citations, prompt, error for each query (query_id, query).

    A query is read (rewrite, intent, filters), its filters become an allowlist, its rewrite is embedded and searched within
    the allowlist, the lists are fused by the intent's weights, reranked by the query as asked and cut off; the metadata of the
    first documents is fetched, and what the excerpts lack after that; a model answers from the excerpts. An error of a
    model becomes the row's ``error`` and leaves the other rows. ``checkpoint`` writes what models have returned, so that they are asked once.
    """
    held = checkpoint or (lambda df: df)
    read = held(intents(queries, models, on_step=on_step))
    lists = allowed(corpus.index, read, on_step, corpus.fields)
    _, _, fused = retrieved(corpus, read, models, lists, weighting=weighting, on_step=on_step)
    fused = held(fused)
    best = held(context(fused, queries, models, on_step=on_step))
    found = with_missing(prefetched(fused, corpus.index), best, corpus.index)
    told = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", *CITATION_PATHS))).alias("citations"))  # twenty and five documents at most
    answers = synthesised(best, queries, models, on_step=on_step)
    none = F.array().cast(told.schema["citations"].dataType)
    return answers.join(told, "query_id", "left").select("query_id", (F.col("error").isNull() & F.col("answer").isNotNull()).alias("ok"), "answer", "reasoning", F.coalesce("citations", none).alias("citations"), "prompt", "error")


# ---- the agent


def _message(role: str, content: Column, **more: Column) -> Column:
    return F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content"), *(c.alias(n) for n, c in more.items())))


CALLS = "array<struct<id:string,name:string,arguments:string>>"


#: What the agent is told first.
AGENT = "Find evidence with the tools before you answer. Back each claim with the id of a document that a tool has returned in this talk, in square brackets, and with no other id."


def agent(queries: DataFrame, models: Models, tools: dict[str, Tool], checkpoint, rounds: int = ROUNDS, attempts: int = ATTEMPTS, on_step: OnStep | None = None) -> DataFrame:
    """query_id, status (answer, unverifiable_answer), answer, doc_ids (cited, sorted), invalid_doc_ids, attempts_used.

    Each round asks the model once for all open queries and runs the tool calls of a kind as one query. A tool takes (query_id, call_id,
    arguments as JSON) and returns (query_id, call_id, result, doc_ids); a call of an unknown tool, or one without a result, becomes an
    error message to the model. After ``rounds`` rounds calls are ignored and the content is the answer. An answer that cites an id
    that was never seen is sent back, ``attempts`` times at most; after that no answer is given.
    """
    empty = F.array().cast("array<string>")
    open_ = checkpoint(queries.select("query_id", F.array(_message("system", F.lit(AGENT)), _message("user", F.col("query"))).alias("messages"), empty.alias("seen"), F.lit(1).alias("attempt")))
    done = None
    for attempt in range(1, attempts + 1):
        answers = None
        active = open_
        for number in range(rounds + 1):
            asked = answered(active.withColumn("_m", F.concat(F.lit("["), F.array_join("messages", ","), F.lit("]"))), "_m", models).drop("_m")
            calls = F.coalesce(F.from_json(F.get_json_object("reply", "$.tool_calls"), CALLS), F.array().cast(CALLS))
            asked = checkpoint(asked.withColumn("calls", F.array().cast(CALLS) if number == rounds else calls).withColumn("content", F.get_json_object("reply", "$.content")))
            ended = asked.where(F.size("calls") == 0).select("query_id", "messages", "seen", "content")
            answers = ended if answers is None else answers.unionByName(ended)
            going = asked.where(F.size("calls") > 0)
            if number == rounds or not going.limit(1).count():
                break
            each = going.select("query_id", F.posexplode("calls").alias("at", "c")).select("query_id", "at", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
            emit(on_step, "agent_tool_call", lambda each=each: each.select("query_id", _data(name=F.col("name"), arguments=F.col("arguments"))))
            results = None
            for name, tool in tools.items():
                part = tool(each.where(F.col("name") == name).select("query_id", "call_id", "arguments")).select("query_id", "call_id", "result", "doc_ids")
                results = part if results is None else results.unionByName(part)
            told = each.join(results, ["query_id", "call_id"], "left") if results is not None else each.withColumn("result", F.lit(None).cast("string")).withColumn("doc_ids", empty)
            emit(on_step, "agent_tool_result", lambda told=told: told.select("query_id", _data(name=F.col("name"), result=F.col("result"))))
            line = _message("tool", F.coalesce("result", F.concat(F.lit("error: no result from "), F.col("name"))), tool_call_id=F.col("call_id"))
            gathered = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("m")))).alias("lines"), F.flatten(F.collect_list(F.coalesce("doc_ids", empty))).alias("new"))
            joined = going.join(gathered, "query_id")
            spoken = _message("assistant", F.col("content"), tool_calls=F.to_json("calls"))
            active = checkpoint(joined.select("query_id", F.concat("messages", F.array(spoken), F.col("lines.m")).alias("messages"), F.array_distinct(F.concat("seen", "new")).alias("seen"), "attempt"))
        judged = checkpoint(answers.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("bad", C.invalid_ids(F.col("content"), F.col("seen"))))
        cited = F.array_sort(C.cited_ids(F.col("content")))
        good = judged.where(F.size("bad") == 0).select("query_id", F.lit("answer").alias("status"), F.col("content").alias("answer"), cited.alias("doc_ids"), F.col("bad").alias("invalid_doc_ids"), F.lit(attempt).alias("attempts_used"))
        emit(on_step, "agent_answer", lambda good=good: good.select("query_id", _data(answer=F.col("answer"), doc_ids=F.col("doc_ids"))))
        done = good if done is None else done.unionByName(good)
        again = judged.where(F.size("bad") > 0)
        if not again.limit(1).count():
            return done
        emit(on_step, "agent_citation_rejected", lambda again=again, attempt=attempt: again.select("query_id", _data(invalid_doc_ids=F.col("bad"), attempt=F.lit(attempt))))
        note = _message("user", F.concat(F.lit("These ids were never retrieved: "), F.array_join("bad", ", "), F.lit(". Cite retrieved ones only.")))
        open_ = checkpoint(again.select("query_id", F.concat("messages", F.array(_message("assistant", F.col("content")), note)).alias("messages"), "seen", F.lit(attempt + 1).alias("attempt")))
    left = judged.where(F.size("bad") > 0).select("query_id", F.lit("unverifiable_answer").alias("status"), F.lit(None).cast("string").alias("answer"), empty.alias("doc_ids"), F.col("bad").alias("invalid_doc_ids"), F.lit(attempts).alias("attempts_used"))
    return done.unionByName(left)


#: The tools' schemas as a model is told them.
TOOLS = [
    {"type": "function", "function": {"name": n, "description": d, "parameters": {"type": "object", "properties": {a: {"type": "string"}}, "required": [a]}}}
    for n, d, a in (
        ("search_es", "full-text search", "query"),
        ("search_milvus_dense", "search by meaning", "query"),
        ("search_milvus_sparse", "search by words", "query"),
        ("lookup_doc", "a document by its id", "doc_id"),
    )
]


def lookup_tool(index: DataFrame) -> Tool:
    """The tool that returns a document's citation metadata, or that there is none; what it finds counts as seen."""

    def run(calls: DataFrame) -> DataFrame:
        wanted = calls.withColumn("doc_id", F.get_json_object("arguments", "$.doc_id"))
        heads = [c for c in ("heading", "subheading") if c in index.columns]
        known = citation_metadata(index) if "masterinfo" in index.columns else index.select(F.col("id").alias("doc_id"), *heads)
        names = [c for c in known.columns if c != "doc_id"]
        found = wanted.join(known.withColumn("_there", F.lit(True)), "doc_id", "left")
        there = F.coalesce("_there", F.lit(False))
        citation = F.when(there, F.struct("doc_id", *names))
        return found.select("query_id", "call_id", F.to_json(F.struct(citation.alias("citation"))).alias("result"), F.when(there, F.array("doc_id")).otherwise(F.array().cast("array<string>")).alias("doc_ids"))

    return run


def tools_of(corpus: Corpus, models: Models, limit: int = 20, searches: retrieval.Searches | None = None) -> dict[str, Tool]:
    """The four tools over a corpus: full-text search, search by vectors and by words (the best over all collections), and lookup.

    ``searches`` are those of a run, of ``TEXT_LIMIT`` documents and ``LIMIT`` chunks at least, which remember what was asked before.
    """
    by_words = searches.sparse if searches else lambda asked: retrieval.sparse_hits(corpus.chunks, asked, written=corpus.words)
    full_text = searches.full_text if searches else lambda asked: retrieval.full_text(corpus.index, asked, written=corpus.fields)

    def flat(hits: DataFrame) -> DataFrame:
        return rank.flattened(hits, ["query_id"]).where(F.col("flat_pos") <= limit).select("query_id", F.col("flat_pos").alias("pos"), "doc_id", "text")

    def by_vector(asked: DataFrame) -> DataFrame:
        vectors = embedded(asked, "query", models).where("vector IS NOT NULL").select("query_id", "vector")
        return flat(retrieval.dense_hits(corpus.vectors, vectors))

    def by_text(asked: DataFrame) -> DataFrame:
        return full_text(asked).where(F.col("pos") <= retrieval.TEXT_LIMIT).select("query_id", "pos", "doc_id", F.col("subheading").alias("text"))

    return {
        "search_es": search_tool(by_text),
        "search_milvus_dense": search_tool(by_vector),
        "search_milvus_sparse": search_tool(lambda asked: flat(by_words(asked))),
        "lookup_doc": lookup_tool(corpus.index),
    }


def search_tool(search) -> Tool:
    """A tool over a batch search: queries (query_id, query) -> hits (query_id, pos, doc_id, text); texts are clipped to 500 characters."""

    def run(calls: DataFrame) -> DataFrame:
        asked = calls.select(F.struct("query_id", "call_id").alias("k"), F.get_json_object("arguments", "$.query").alias("query")).where("query IS NOT NULL")
        hits = search(asked.select(F.to_json("k").alias("query_id"), "query"))
        rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", T.clipped(F.col("text")).alias("text")))).alias("h"))
        key = F.from_json("query_id", "query_id string, call_id string")
        return rows.select(key.alias("k"), F.to_json("h").alias("result"), F.array_distinct(F.col("h.doc_id")).alias("doc_ids")).select("k.query_id", "k.call_id", "result", "doc_ids")

    return run


def tool_names() -> str:
    return json.dumps([t["function"]["name"] for t in TOOLS])
