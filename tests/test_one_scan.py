"""A single batch over texts is scored where the texts are scanned: no index is written, and no text or posting is shuffled."""

import pytest
from pyspark.sql import functions as F

from docketlake.operators import blocks, postings, rank, score
from docketlake.plans import registry, retrieval
from docketlake.sources import fixtures

SF = "/root/testdata/sf0.001"
NAMES = postings.Names("g", "d", "parent")


@pytest.fixture(scope="module")
def texts(spark):
    docs = [(g, f"d{i:03}", f"p{i % 9}", f"Same w{i % 7} " * (1 + i % 5) + f"x{i % 11}") for i in range(300) for g in ("a", "b") if g == "a" or i % 3]
    docs += [("b", "only", "p0", "same"), ("a", "empty", "p0", ""), ("a", "none", "p0", None), ("a", "long", "p0", "same other " * 300), ("c", "apart", "p0", "w3")]
    return spark.createDataFrame(docs, "g string, d string, parent string, text string").repartition(3)


def asked(spark):
    return score.query_terms(spark.createDataFrame([("q1", "same w3"), ("q2", "w5 same x1 x1"), ("q3", "nothing"), ("q4", "")], "query_id string, query string"))


def best(hits, k):
    return sorted(map(tuple, rank.top(hits, ["query_id", "g"], [F.col("score").desc(), F.col("d")], k).select("query_id", "g", "d", "score").collect()))


@pytest.mark.parametrize("k", [2, 400])
@pytest.mark.parametrize(("tokens", "most", "block", "words"), [(1 << 21, 1 << 15, 1 << 11, 1 << 15), (100, 40, 16, 1 << 15), (1 << 21, 32, 64, 1)])
def test_scan_equals_plain_scores(spark, texts, monkeypatch, k, tokens, most, block, words):
    monkeypatch.setattr(blocks, "SLICE_TOKENS", tokens)
    monkeypatch.setattr(blocks, "SLICE_TEXTS", most)
    monkeypatch.setattr(blocks, "SLICE_BLOCK", block)
    monkeypatch.setattr(postings, "MOST_WORDS", words)
    every = score.bm25(texts, asked(spark), "g", "d").withColumn("score", F.round("score", 6))
    found = postings.search_texts(texts, asked(spark), k, NAMES)
    assert best(found, k) == best(every, k) and best(every, k)
    assert found.join(texts, ["g", "d", "parent"]).count() == found.count()


def test_each_task_hands_on_its_best_only(spark, texts):
    found = postings.search_texts(texts, asked(spark), 3, NAMES)
    assert found.count() <= 3 * 2 * 3 * 3
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_nothing_to_search(spark, texts):
    none = postings.search_texts(texts.where("d = 'none'"), asked(spark), 3, NAMES)
    assert none.count() == 0 and none.columns == ["query_id", "g", "d", "parent", "score"]
    assert postings.search_texts(texts, asked(spark).where("query_id = 'q4'"), 3, NAMES).count() == 0


@pytest.mark.parametrize("name", ["elbow_capped", "elbow_per_collection"])
def test_elbows_write_no_index(spark, monkeypatch, name):
    want = rank.elbow(retrieval.sparse_lists(spark, SF), ["query_id", "collection"], ties=[F.col("chunk_id")], max_keep=5 if name == "elbow_capped" else None)
    want = sorted(map(tuple, want.select("query_id", "collection", "rank", "chunk_id", "score").collect()))

    def never(*_, **__):
        raise AssertionError("an index is written")

    monkeypatch.setattr(retrieval, "words_index", never)
    monkeypatch.setattr(postings, "write", never)
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())) == want and want


def test_ranks_are_those_of_lists(spark):
    columns = ["query_id", "collection", "pos", "chunk_id", "doc_id", "score"]
    want = retrieval.sparse_lists(spark, SF).select(*columns)
    found = retrieval.sparse_ranks(fixtures.chunks(spark, SF), fixtures.queries(spark, SF)).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["sparse_bm25_topk", "first_unique_docs", "hits_per_collection", "collection_ranks", "first_collection"])
def test_lists_without_texts_write_no_index(spark, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("an index is written")

    monkeypatch.setattr(retrieval, "words_index", never)
    monkeypatch.setattr(postings, "write", never)
    assert registry.QUERIES[name](spark, SF).columns
