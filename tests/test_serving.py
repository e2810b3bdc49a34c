"""Request batches answered end to end, bad requests, branches at fault, the stream, and what models are told."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docketlake.operators import filters
from docketlake.plans import modes, retrieval, serving
from docketlake.plans.models import Offline, Researcher, _each
from docketlake.plans.retrieval import Corpus
from docketlake.storage import kept

SF = "/root/testdata/sf0.001"
REQUESTS = "query_id string, query string, mode string, trace boolean, rerank boolean"


@pytest.fixture(scope="module")
def corpus(spark):
    return retrieval.corpus(spark, SF)


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "seq").collect():
        out.setdefault(r.query_id, []).append((r.type, r.step, json.loads(r.data)))
    return out


def test_a_batch_of_three(spark, corpus):
    asked = [("a", "the and with", "both", True, True), ("b", "the Delhi court", "instant", None, None), ("c", "Party 5 Ltd", "ai_mode", False, None), ("d", " ", None, None, None), ("e", "x", "other", None, None), ("f", None, None, None, None)]
    began = time.time()
    got = rows(serving.search(spark.createDataFrame(asked, REQUESTS), corpus, Offline()))
    assert time.time() - began < 120
    assert [t for t, _, _ in got["b"]] == ["instant_result"] and [t for t, _, _ in got["c"]] == ["ai_mode_done"]
    kinds = [(t, s) for t, s, _ in got["a"]]
    assert kinds[-2:] == [("instant_result", None), ("ai_mode_done", None)]
    steps = [s for t, s in kinds if t == "ai_mode_trace"]
    assert steps == ["es_search", "milvus_dense", "milvus_sparse", "instant_reranked", "intent", "filters_resolved", "milvus_dense", "milvus_sparse", "rrf_merge", "rerank", "synthesis_prompt"]
    result = got["a"][-2][2]
    assert set(result) <= {"es", "dense", "sparse", "reranked"} and len(result["es"]) > 0 and len(result["reranked"]) > 0
    assert [h["pos"] for h in result["es"]] == list(range(1, len(result["es"]) + 1))
    frame = got["a"][0][2]
    assert frame["hit_count"] == len(result["es"]) and [h["doc_id"] for h in frame["top_hits"]] == [h["doc_id"] for h in result["es"]][:10]
    assert {q: got[q][0][2]["error"] for q in "def"} == {"d": "no query", "e": "unknown mode: other", "f": "no query"}
    assert all(t == "ai_mode_error" and len(got[q]) == 1 for q in "def" for t, _, _ in got[q])


def test_a_missing_branch_leaves_the_others(spark, corpus):
    part = Corpus(corpus.index, corpus.chunks, None, corpus.fields, corpus.words)
    got = rows(serving.search(spark.createDataFrame([("a", "the and with", "instant", True, False)], REQUESTS), part, Offline()))
    result = got["a"][-1][2]
    assert result["milvus_error"] == "ValueError: no vectors" and "es_error" not in result and len(result["es"]) > 0 and len(result["sparse"]) > 0 and "dense" not in result


def test_errors_of_models_end_their_own_request(spark, corpus):
    class Partly(Offline):
        def chat(self, messages):
            if any("Question: bad" in m[-1]["content"] for m in messages):
                raise RuntimeError("refused")
            return super().chat(messages)

    got = rows(serving.search(spark.createDataFrame([("a", "the and with", "ai_mode", False, False), ("b", "bad words", "ai_mode", False, False)], REQUESTS), corpus, Partly()))
    assert got["a"][-1][0] == "ai_mode_done" and got["b"][-1][0] == "ai_mode_error" and "refused" in got["b"][-1][2]["error"]


def test_halving_finds_the_bad_item_and_timeouts_are_not_repeated():
    calls = []

    def call(items):
        calls.append(len(items))
        if 7 in items:
            raise ValueError("seven")
        return [x * 2 for x in items]

    assert _each(call, list(range(64)), str) == [x * 2 if x != 7 else "seven" for x in range(64)] and len(calls) == 13

    def slow(items):
        calls.append(len(items))
        raise TimeoutError("late")

    calls.clear()
    assert _each(slow, [1, 2, 3], str) == ["late"] * 3 and calls == [3]


def test_agent_messages_with_tools(spark, corpus):
    models = Researcher()
    asked = spark.createDataFrame([("a", "the and with"), ("b", "the and"), ("c", "zzzzqqq")], "query_id string, query string")
    got = rows(serving.agent(asked, models, modes.tools_of(corpus, models), kept))
    steps = {q: [s for _, s, _ in v] for q, v in got.items()}
    assert steps["a"] == ["agent_tool_call", "agent_tool_call", "agent_tool_result", "agent_tool_result", "agent_tool_call", "agent_tool_result", "agent_answer", None] and got["a"][-1][0] == "agent_done"
    assert "agent_citation_rejected" in steps["b"] and got["b"][-1][0] == "agent_done" and len(got["b"][-1][2]["doc_ids"]) >= 1
    assert got["c"][-1][2] == {"answer": "Nothing was found.", "doc_ids": []}


def test_a_stream_is_tried_again_when_a_batch_fails(spark, tmp_path):
    schema = "query_id string, query string"
    spark.createDataFrame([("a", "x")], schema).write.parquet(str(tmp_path / "in"))
    fails = [True]

    def answer(requests):
        if fails.pop() if fails else False:
            raise OSError("the gateway is away")
        return requests.withColumn("answer", F.lit("y"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        serving.serve(stream, answer, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="the gateway is away"):
        run()
    assert not (tmp_path / "out").exists()
    run()
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "x", "y")]


def test_what_the_reading_model_is_told_and_date_filters(spark, corpus):
    class Reader(Offline):
        def chat(self, messages):
            assert all("intent is one of" in m[0]["content"] and "headnotes" in m[0]["content"] and "date_range" in m[0]["content"] for m in messages)
            reply = {"rewritten_query": "orders from 1995 to 1999", "intent": "conceptual", "filters": {"date_range": json.dumps({"gte": "1995-01-01", "lte": "1999-12-31"}), "court": "nowhere"}}
            return [{"content": json.dumps(reply), "tool_calls": []} for _ in messages]

    read = kept(modes.intents(spark.createDataFrame([("q", "orders from 1995 to 1999")], "query_id string, query string"), Reader()))
    row = read.first()
    assert row.filters == {} and row.dates == {"gte": "1995-01-01", "lte": "1999-12-31"}
    listed = modes.allowed(corpus.index, read)
    want = corpus.index.where("formatteddocumentdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'").select("id")
    assert {r.doc_id for r in listed.documents.collect()} == {r.id for r in want.collect()} and listed.modes.first()["mode"] == "applied"
    assert filters.MOST == 1000
