"""Searches that the steps of a run share: an evaluation run scans the tables, writes no index, and looks for no text twice."""

import pytest
from pyspark.sql import functions as F

from docketlake.operators import postings
from docketlake.plans import registry, retrieval
from docketlake.plans.kept import kept
from docketlake.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "texts", "documents"), [("evaluation_run", 1, 1), ("agent_run", 1, 1), ("instant", 1, 1)])
def test_no_index_and_no_text_twice(spark, monkeypatch, name, texts, documents):
    def never(*_, **__):
        raise AssertionError("an index is written")

    calls = {"search_texts": 0, "search_documents": 0}
    for each in calls:
        monkeypatch.setattr(postings, each, lambda *a, each=each, f=getattr(postings, each), **b: calls.update({each: calls[each] + 1}) or f(*a, **b))
    for each in ("fields_index", "words_index"):
        monkeypatch.setattr(retrieval, each, never)
    monkeypatch.setattr(postings, "write", never)
    assert registry.QUERIES[name](spark, SF).columns
    assert calls == {"search_texts": texts, "search_documents": documents}


def test_a_text_is_searched_once(spark):
    asked = []

    def search(queries):
        asked.append(sorted(r.query for r in queries.collect()))
        return queries.where("query <> 'none'").select("query_id", F.length("query").alias("pos"), F.lit(None).cast("string").alias("doc_id"))

    held = retrieval.Remembered(search)
    make = lambda *rows: spark.createDataFrame(rows, "query_id string, query string")
    found = lambda *rows: sorted((r.query_id, r.pos) for r in held(make(*rows)).collect())
    assert found(("a", "x"), ("b", "x"), ("c", "none"), ("d", None)) == [("a", 1), ("b", 1)]
    assert found(("e", "none"), ("f", "x")) == [("f", 1)] and len(asked) == 1
    assert found(("g", "long"), ("h", "x")) == [("g", 4), ("h", 1)]
    assert asked == [["none", "x"], ["long"]]


def test_batches_are_found_as_one_by_one(spark):
    chunks = fixtures.chunks(spark, SF)
    queries = fixtures.queries(spark, SF).select("query_id", "query")
    modes = kept(queries.select("query_id", F.when(F.substring("query_id", -1, 1) < "5", "applied").otherwise("none").alias("mode")))
    listed = kept(modes.where("mode = 'applied'").join(fixtures.index(spark, SF).where("doc_number % 3 = 0").select(F.col("id").alias("doc_id"))))
    allowed = retrieval.Allowed(listed.select("query_id", "doc_id"), modes)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "collection", "pos", "chunk_id", "doc_id", "score", "text").collect()))
    plain, within = retrieval.sparse_batches(chunks, [(queries, None), (queries, allowed)], 5)
    words = retrieval.words_index(spark, SF)
    assert rows(plain) == rows(retrieval.sparse_hits(chunks, queries, 5, written=words))
    assert rows(within) == rows(retrieval.sparse_hits(chunks, queries, 5, allowed, words)) == rows(retrieval.sparse_hits(chunks, queries, 5, allowed))
    assert rows(plain) != rows(within) and rows(within)
