import json
import math

import pytest
from pyspark.sql import functions as F

from docketlake.functions import values as V
from docketlake.operators import evaluate, filters, fuse, postings, rank, score
from docketlake.plans import modes
from docketlake.plans.models import Offline, embedded, resolved
from docketlake.sources import cases
from docketlake.streaming import trace


def scores(spark, values):
    return spark.createDataFrame([("q", i, float(v)) for i, v in enumerate(values)], "query_id string, pos int, score double")


@pytest.mark.parametrize(
    ("values", "cap", "kept"),
    [([10, 1, 0.1], None, 1), ([0.9, 0.85, 0.3], None, 2), ([0.9, 0.88, 0.86, 0.84, 0.82, 0.8], 5, 5), ([5.0] * 12, None, 12), ([0, 0, 0], None, 3), ([-1, -1.5], None, 1), ([], None, 0)],
)
def test_elbow(spark, values, cap, kept):
    assert rank.elbow(scores(spark, values), ["query_id"], ties=[F.col("pos")], max_keep=cap).count() == kept


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, src_ord int, pos int, chunk_id string")


def order(df, key="chunk_id"):
    return [r[key] for r in fuse.fused_rank(df).orderBy("fused_pos").collect()]


def test_rrf_overlap_wins_and_ties_keep_insertion_order(spark):
    both = hits(spark, [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c")])
    assert order(fuse.reciprocal(both, "chunk_id")) == ["b", "a", "c"]
    tie = hits(spark, [("q", 0, 1, "a"), ("q", 1, 1, "b")])
    assert order(fuse.reciprocal(tie, "chunk_id")) == ["a", "b"]
    weighted = tie.withColumn("weight", F.when(F.col("src_ord") == 1, 1.5).otherwise(0.5))
    assert order(fuse.reciprocal(weighted, "chunk_id", F.col("weight"))) == ["b", "a"]
    assert fuse.reciprocal(hits(spark, [("q", 0, 1, "a"), ("q", 0, 2, "a")]), "chunk_id").first().rrf_score == round(1 / 61 + 1 / 62, 9)


def test_collapse_and_doc_rank(spark):
    df = spark.createDataFrame([("q", 1, "d1"), ("q", 2, "d1"), ("q", 3, "gold")], "query_id string, pos int, doc_id string")
    assert [(r.doc_id, r.pos) for r in fuse.collapsed(df, ["query_id"]).orderBy("pos").collect()] == [("d1", 1), ("gold", 2)]
    gold = spark.createDataFrame([("q", "gold"), ("q", "absent")], "query_id string, doc_id string")
    assert rank.gold_rank(df, gold, ["query_id"]).first().rank == 2
    assert rank.gold_rank(df, gold.where("doc_id = 'absent'"), ["query_id"]).count() == 0


def test_pages_are_clamped(spark):
    df = spark.createDataFrame([("q", i) for i in range(1, 13)], "query_id string, pos int")
    assert sorted(r.pos for r in rank.page(df, ["query_id"], "pos", F.lit(9)).collect()) == [11, 12]
    assert rank.page(df, ["query_id"], "pos", F.lit(0)).count() == 10


def test_cards(spark):
    es = spark.createDataFrame([("q", 1, "d1", 9.0, "h", "s"), ("q", 2, "d1", 8.0, "h", "s2")], "query_id string, pos int, doc_id string, score double, heading string, subheading string")
    vec = spark.createDataFrame([("q", 1, "d1", 0.9, "facts", "t"), ("q", 2, "d2", 0.1, "facts", "low"), ("q", 3, "d2", 0.7, "held", "high"), ("q", 4, "d3", 0.7, "held", "x")], "query_id string, flat_first int, doc_id string, score double, collection string, text string")
    got = [(r.source, r.doc_id, r.snippet) for r in fuse.cards(es, vec, vec.where("doc_id = 'd3'")).orderBy("card_pos").collect()]
    assert got == [("es", "d1", "s"), ("milvus_dense", "d2", "high"), ("milvus_dense", "d3", "x"), ("milvus_sparse", "d3", "x")]
    reranked = spark.createDataFrame([("q", "d", 1.0, None, None, None)], "query_id string, doc_id string, rerank_score double, heading string, subheading string, text string")
    assert fuse.reranked_cards(reranked).first().snippet == ""


def index(spark):
    rows = [("1", "[2020] 1 ITR 2 (SC)", "A Ltd vs. B", "gift tax", ["J One"], "2001-01-01"), ("2", "Section - 17D", "Northwind Traders", "income", ["J Two"], "2010-01-01"), ("3", "[2019] 5 (Delhi)", "Traders", "gift", ["J One", "J Three"], None)]
    return spark.createDataFrame(rows, "id string, heading string, subheading string, fullcontent string, judges array<string>, d string").withColumn("formatteddocumentdate", F.col("d").cast("date"))


@pytest.mark.parametrize(
    ("given", "ids"),
    [
        ({"court": "Supreme Court"}, ["1"]),
        ({"section": "17D"}, ["2"]),
        ({"act": "gift act"}, ["1", "3"]),
        ({"judge": "J One"}, ["1", "3"]),
        ({"judge": "Three"}, ["3"]),
        ({"party": "Northwind Traders"}, ["2"]),
        ({"date_range": {"gte": "2005-01-01"}}, ["2"]),
        ({"court": "Supreme Court", "date_range": "2020"}, ["1"]),
        ({"court": "Delhi bench"}, ["3"]),
        ({"party": "nobody"}, []),
    ],
)
def test_allowlist(spark, given, ids):
    assert sorted(r.id for r in filters.allowlist(index(spark), given).collect()) == ids


def test_allowlist_without_known_filters(spark):
    assert filters.allowlist(index(spark), {}) is None
    with pytest.raises(ValueError):
        filters.allowlist(index(spark), {"colour": "red"})
    with pytest.raises(ValueError):
        filters.allowlist(index(spark), {"date_range": "2020"})


def test_empty_allowlist_restricts_nothing(spark):
    h = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "query_id string, doc_id string")
    allowed = spark.createDataFrame([("b", "2")], "query_id string, doc_id string")
    m = spark.createDataFrame([("a", "empty_ignored"), ("b", "applied")], "query_id string, mode string")
    assert sorted(map(tuple, filters.within(h, allowed, m).collect())) == [("a", "1"), ("b", "2")]


def test_bm25_against_a_plain_loop(spark):
    docs = {"x": "gift tax gift", "y": "tax", "z": "other words here"}
    df = spark.createDataFrame([("g", k, v) for k, v in docs.items()] + [("g", "n", None)], "collection string, chunk_id string, text string")
    terms = spark.createDataFrame([("q", "gift"), ("q", "tax"), ("q", "none")], "query_id string, term string")
    got = {r.chunk_id: r.score for r in score.bm25(df, terms, "collection", "chunk_id").collect()}
    n, avg = 3, sum(len(v.split()) for v in docs.values()) / 3
    for k, v in docs.items():
        w = v.split()
        want = 0.0
        for t in ("gift", "tax"):
            d = sum(t in x.split() for x in docs.values())
            tf = w.count(t)
            want += math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        assert got.get(k, 0.0) == pytest.approx(want)


def test_few_terms_are_pushed_to_the_scan_of_a_written_index(spark, tmp_path):
    df = spark.createDataFrame([(g, f"{g}{i}", " ".join(f"w{(i * k) % 7}" for k in range(1, 2 + i % 5))) for g in "ab" for i in range(30)] + [("a", "n", None)], "collection string, chunk_id string, text string")
    terms = spark.createDataFrame([("q", "w1"), ("q", "w2"), ("r", "w6")], "query_id string, term string")
    index = postings.write(df, str(tmp_path), "collection", "chunk_id")
    read = postings.search(index, terms, 5, apart=True, prune=False)
    key = lambda r: (r.query_id, r.collection, r.chunk_id, round(r.score, 6))
    assert sorted(map(key, read.collect())) == sorted(map(key, score.bm25(df, terms, "collection", "chunk_id").collect()))
    assert "PushedFilters: [In(term" in index.postings(terms)._jdf.queryExecution().toString()


def test_fuzzy_against_all_pairs(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms, words = ["of", "tax", "gifts", "ruling"], ["of", "if", "tax", "fax", "taxes", "gift", "gilt", "rulings", "ruléng", "rul"]
    got = {(r["term"], r["match"]): r.distance for r in score.fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    most = lambda t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
    assert got == {(t, w): distance(t, w) for t in terms for w in words if distance(t, w) <= most(t)}


def test_value_factors_are_neutral_when_not_positive(spark):
    df = spark.createDataFrame([(None, 0.0, -10.0), (5.0, 100.0, 8.0)], "a double, b double, c double").select(V.value_factors(F.col("a"), F.col("b"), F.col("c")).alias("f"))
    a, b = (r.f for r in df.collect())
    assert a == 1.0 and b == pytest.approx(math.log10(11.6))


def test_pass_rates_and_deltas(spark):
    rows = [(r, q, "es", k, 5) for r, ks in (("a", [1, 10, None]), ("b", [10, 10, None])) for q, k in enumerate(ks)]
    rates = evaluate.pass_rates(spark.createDataFrame(rows, "run string, query_id int, stage string, rank int, pass_at int"))
    assert {r.run: (r.passed, r.total) for r in rates.collect()} == {"a": (1, 3), "b": (0, 3)}
    flags = spark.createDataFrame([("a", True), ("b", None)], "run string, skip_agentic boolean")
    assert evaluate.comparison(rates, "a", flags).first().delta == -1
    results = spark.createDataFrame([("a", True), ("a", None)], "run string, citation_valid boolean")
    assert tuple(evaluate.citation_rates(results).first()) == ("a", 1, 2)


def test_case_loading(spark, tmp_path):
    good = {"id": "Q1", "pair": "p", "class": "direct", "query": "x", "gold_doc_ids": ["1"], "expected_collections": ["facts"], "pass_at": 5}

    def load(*rows):
        (tmp_path / "c.json").write_text(json.dumps(list(rows)))
        return cases.load_cases(spark, str(tmp_path / "c.json"))

    assert load(good).count() == 1
    for bad in ([], [good, good], [good | {"query": " "}], [good | {"expected_collections": ["nope"]}], [good | {"gold_doc_ids": []}], [{k: v for k, v in good.items() if k != "pass_at"}]):
        with pytest.raises(ValueError):
            load(*bad)
    with pytest.raises(ValueError):
        evaluate.selected(load(good), ["Q9"])
    assert evaluate.selected(load(good), ["Q1"], "direct").count() == 1


def test_run_files_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("Q1", 1), ("Q2", 2)], "id string, rank int")
    a = cases.write_run(df, str(tmp_path / "runs"), "one", {"limit": 50})
    b = cases.write_run(df.orderBy(F.desc("id")), str(tmp_path / "runs"), "two", {"limit": 50}, latest=False)
    assert a == b and (tmp_path / "runs/run=latest").exists() and spark.read.json(str(tmp_path / "runs")).count() == 6
    made = []

    def make():
        made.append(1)
        return df

    key = cases.cache_key("Q/1", {"slm": None}, {"limit": 50})
    assert key != cases.cache_key("Q/1", {"slm": None}, {"limit": 20}) and "/" not in key
    for _ in range(2):
        assert cases.cached(spark, str(tmp_path / "cache"), key, make).count() == 2
    assert made == [1]


def script(replies):
    """A model that replies from a list, by the number of its messages in the conversation."""

    class Script:
        def chat(self, messages):
            return [replies[min(sum(m["role"] == "assistant" for m in ms), len(replies) - 1)] for ms in messages]

    return Script()


def _call(name, **arguments):
    return {"content": "", "tool_calls": [{"id": "c1", "name": name, "arguments": json.dumps(arguments)}]}


def _agent(spark, replies, rounds=8):
    queries = spark.createDataFrame([("q", "what")], "query_id string, query string")
    docs = spark.createDataFrame([("d1", "head", "sub")], "id string, heading string, subheading string")
    return modes.agent(queries, script(replies), {"lookup_doc": modes.lookup_tool(docs)}, lambda df: df.checkpoint(), rounds=rounds).first()


def test_agent_answers_what_it_has_seen(spark):
    got = _agent(spark, [_call("lookup_doc", doc_id="d1"), {"content": "It is [d1].", "tool_calls": []}])
    assert (got.status, got.answer, got.doc_ids, got.attempts_used) == ("answer", "It is [d1].", ["d1"], 1)


def test_agent_gives_up_on_ids_never_seen(spark):
    got = _agent(spark, [{"content": "It is [d9].", "tool_calls": []}])
    assert (got.status, got.answer, got.attempts_used) == ("unverifiable_answer", None, 3)


def test_agent_stops_calling_after_its_rounds(spark):
    got = _agent(spark, [_call("lookup_doc", doc_id="none") | {"content": "done"}], rounds=2)
    assert (got.status, got.answer) == ("answer", "done")


def test_intents_fall_back(spark):
    class Bad:
        def chat(self, messages):
            replies = {"a": "no json", "b": json.dumps({"rewritten_query": "b in 2019", "intent": "x", "filters": None}), "c SC": json.dumps({"rewritten_query": "c SC please", "intent": "conceptual", "filters": {"court": "SC", "judge": "None", "colour": "c"}})}
            return [{"content": replies[m[-1]["content"]], "tool_calls": []} for m in messages]

    queries = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c SC")], "query_id string, query string")
    got = {r.query_id: (r.rewritten_query, r.intent, r.filters) for r in modes.intents(queries, Bad()).collect()}
    assert got == {"1": ("a", "unknown", {}), "2": ("b", "unknown", {}), "3": ("c SC please", "conceptual", {"court": "SC"})}


def test_models(spark):
    df = spark.createDataFrame([("tax",), ("tax",), ("gift",)], "t string")
    assert embedded(df, "t", Offline()).count() == 3
    roles = spark.createDataFrame([("slm", "m"), ("embedder", "m"), ("nobody", "m")], "r string, o string").select(resolved(F.col("r"), F.col("o")).alias("m"))
    assert [r.m for r in roles.collect()] == ["m", "voyage", None]


def test_trace_stream(spark, tmp_path):
    frames = spark.createDataFrame([("q", "intent", "step", "2024-01-01 00:00:01"), ("q", "rerank", "ai_mode_done", "2024-01-01 02:00:00")], "query_id string, step string, type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    trace.to_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = trace.per_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM windows").count() >= 1
    numbered = trace.numbered(frames, ["query_id"], [F.col("ts")])
    assert tuple(trace.loading(numbered).first()) == ("q", ["intent", "rerank"], False)
