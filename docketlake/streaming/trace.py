"""Trace frames of requests as streams and tables, and the client's state from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the steps and of the messages that end a request.
STEPS = ("intent", "filters_resolved", "es_search", "milvus_dense", "milvus_sparse", "rrf_merge", "rerank", "synthesis_prompt", "agent_tool_call", "agent_tool_result", "agent_citation_rejected", "agent_answer", "instant_reranked")
TERMINAL = ("instant_result", "ai_mode_done", "ai_mode_error", "agent_done", "agent_unverifiable", "agent_error")


def ranked(hits: DataFrame, n: int = 10) -> DataFrame:
    """query_id, data (JSON): the first ``n`` of a list (pos, doc_id, score) with their ranks, and how many there are."""
    best = F.array_sort(F.collect_list(F.when(F.col("pos") <= n, F.struct(F.col("pos").cast("int").alias("rank"), "doc_id", "score"))))
    held = hits.groupBy("query_id").agg(F.count("*").alias("hit_count"), best.alias("top_hits"))
    return held.select("query_id", F.to_json(F.struct("hit_count", "top_hits")).alias("data"))


def per_collection(hits: DataFrame, n: int = 5, preview: int = 200) -> DataFrame:
    """query_id, data (JSON): of each collection how many hits there are and the first ``n`` with the start of their text."""
    shown = F.struct(F.col("pos").cast("int").alias("rank"), "chunk_id", "doc_id", "score", F.substring("text", 1, preview).alias("text_preview"))
    held = hits.groupBy("query_id", "collection").agg(F.count("*").alias("hit_count"), F.array_sort(F.collect_list(F.when(F.col("pos") <= n, shown))).alias("top_hits"))
    every = held.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("collection").alias("name"), "hit_count", "top_hits"))).alias("collections"))
    return every.select("query_id", F.to_json(F.struct("collections")).alias("data"))


def merged(fused: DataFrame, n: int = 15, preview: int = 200) -> DataFrame:
    """query_id, data (JSON): how many candidates fusion gave, and the first of them."""
    shown = F.struct(F.col("fused_pos").cast("int").alias("rank"), "chunk_id", "doc_id", "rrf_score", F.substring("text", 1, preview).alias("text_preview"))
    held = fused.groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.array_sort(F.collect_list(F.when(F.col("fused_pos") <= n, shown))).alias("top_candidates"))
    return held.select("query_id", F.to_json(F.struct("candidate_count", "top_candidates")).alias("data"))


def line(step: Column, data: Column) -> Column:
    """What a client shows for a step in one line."""
    get = lambda path: F.coalesce(F.get_json_object(data, path), F.lit(""))
    count = lambda path: F.coalesce(F.json_array_length(F.get_json_object(data, path)), F.lit(0)).cast("string")
    sizes = F.from_json(F.get_json_object(data, "$.collections"), "array<struct<hit_count:bigint>>")["hit_count"]
    total = F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("string")
    return (
        F.when(step == "intent", F.concat(F.lit('"'), get("$.query"), F.lit('" -> "'), get("$.rewritten_query"), F.lit('" ('), get("$.intent"), F.lit(")")))
        .when(step == "filters_resolved", F.concat(get("$.doc_id_count"), F.lit(" documents matched")))
        .when(step == "es_search", F.concat(get("$.hit_count"), F.lit(" hits")))
        .when(step.isin("milvus_dense", "milvus_sparse"), F.concat(count("$.collections"), F.lit(" collections, "), total, F.lit(" hits")))
        .when(step == "rrf_merge", F.concat(get("$.candidate_count"), F.lit(" candidates merged")))
        .when(step == "rerank", F.concat(F.lit("top "), count("$.top_hits"), F.lit(" kept")))
        .when(step == "synthesis_prompt", F.concat(F.length(get("$.prompt")).cast("string"), F.lit(" characters")))
        .when(step == "agent_tool_call", F.concat(get("$.name"), F.lit("("), get("$.arguments"), F.lit(")")))
        .when(step == "agent_tool_result", F.when(F.get_json_object(data, "$.result").isNull(), "no result").otherwise(F.concat(F.length(get("$.result")).cast("string"), F.lit(" characters"))))
        .when(step == "agent_citation_rejected", F.concat(F.lit("attempt "), get("$.attempt"), F.lit(": unknown ids "), get("$.invalid_doc_ids")))
        .when(step == "agent_answer", F.concat(count("$.doc_ids"), F.lit(" documents cited")))
        .otherwise("")
    )


def of_steps(steps: list[tuple[str, DataFrame]]) -> DataFrame | None:
    """type, step, query_id, ord, data of the frames that a mode has told, in the order of its stages; None if there are none."""
    out = None
    for number, (step, frames) in enumerate(steps):
        part = frames.select("query_id", F.lit(number).alias("ord"), F.lit("ai_mode_trace").alias("type"), F.lit(step).alias("step"), "data")
        out = part if out is None else out.unionByName(part)
    return out


def numbered(frames: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Frames with their place within a request and path; there is no order across paths."""
    return frames.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def summary(frames: DataFrame, at: str = "ts") -> DataFrame:
    """query_id, step, frames, first, last; for batches and for streams in update or complete mode."""
    return frames.groupBy("query_id", "step").agg(F.count("*").alias("frames"), F.min(at).alias("first"), F.max(at).alias("last"))


def per_window(frames: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Frames per step in windows of event time; on a stream, windows close once the watermark is past them."""
    return frames.withWatermark(at, late).groupBy(F.window(at, width), "step").agg(F.count("*").alias("frames")).select(F.col("window.start").alias("start"), "step", "frames")


def loading(frames: DataFrame) -> DataFrame:
    """query_id, steps (in order), loading: what a client shows; a query is loading until its terminal message, and a new query (a frame of type ``query``) starts anew."""
    last = F.max_by("type", "seq")
    frames = frames.withColumn("_begun", F.max(F.when(F.col("type") == "query", F.col("seq"))).over(Window.partitionBy("query_id")))
    frames = frames.where("_begun IS NULL OR seq > _begun")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda s: s["step"])
    return frames.groupBy("query_id").agg(ordered.alias("steps"), (~last.isin(*TERMINAL)).alias("loading"))


def latest_results(patches: DataFrame) -> DataFrame:
    """conv_id, msg_id, mode, result: the last patch of each message and mode."""
    return patches.groupBy("conv_id", "msg_id", "mode").agg(F.max_by("result", "seq").alias("result"))


def appended(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """messages (conv_id, msg_id, role, text) and, for each asked question (conv_id, text, new), a user message and an empty assistant message at its end.

    A question with ``new`` opens a conversation; others follow the last message of theirs.
    """
    last = messages.groupBy("conv_id").agg(F.max("msg_id").alias("_last"))
    placed = asked.join(last, "conv_id", "left").withColumn("_last", F.when(F.col("new"), F.lit(-1)).otherwise(F.coalesce("_last", F.lit(-1))))
    pair = F.array(F.struct(F.lit(1).alias("n"), F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit(2).alias("n"), F.lit("assistant").alias("role"), F.lit("").alias("text")))
    new = placed.select("conv_id", "_last", F.explode(pair).alias("m")).select("conv_id", (F.col("_last") + F.col("m.n")).alias("msg_id"), "m.role", "m.text")
    return messages.select("conv_id", "msg_id", "role", "text").unionByName(new)


def missing_modes(messages: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """Messages that have no result in the mode yet, which switching to it runs."""
    have = results.where(F.col("mode") == mode).select("conv_id", "msg_id")
    return messages.join(have, ["conv_id", "msg_id"], "left_anti")


def kept_within(conversations: DataFrame, quota: int, by: list[str], size: Column, order: list[Column]) -> DataFrame:
    """The newest conversations whose sizes add up to the quota at most; oldest go first."""
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return conversations.withColumn("_total", total).where(F.col("_total") <= quota).drop("_total")


def persisted(conversations: DataFrame, quota: int, by: list[str], order: list[Column], messages: str = "messages") -> DataFrame:
    """What a store of ``quota`` characters holds: messages (role, text, steps) without their trace steps, of the newest conversations that fit."""
    bare = conversations.withColumn(messages, F.transform(messages, lambda m: m.dropFields("steps")))
    return kept_within(bare, quota, by, F.length(F.to_json(messages)), order)


def well_formed(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """Conversations whose every message has a known role and a text."""
    return conversations.where(F.forall(messages, lambda m: m["role"].isin("user", "assistant", "system") & m["text"].isNotNull()))


def to_sink(frames: DataFrame, path: str, checkpoint: str):
    """Append a stream of frames to a table; a batch that fails is tried again by the query, so frames come once."""
    return frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
