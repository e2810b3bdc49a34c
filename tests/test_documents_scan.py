"""A batch of full-text queries scans the documents: scores and phrases are those of the written index, and none is written."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import blocks, postings, rank, score
from docketlake.plans import registry, retrieval
from docketlake.sources import fixtures
from docketlake.storage import new_folder

SF = "/root/testdata/sf0.001"
NAMES = postings.Names("g", "d")
WORDS = [f"w{i}" for i in range(25)] + ["élan", "x"]
PHRASES = [("q1", "w0 w1"), ("q1", "W0, w1"), ("q2", "w0 w0 w0"), ("q3", "w1 w0 w2"), ("q4", "Élan"), ("q5", "w0 nothing"), ("q6", " - "), ("q6", "w1"), ("q7", "w0 w1"), ("q7", "w1 w0 w1"), ("q8", "x x x x x")]
ASKED = [("q1", "w1 w7 w20"), ("q2", "w0 élan"), ("q3", "x w3"), ("q4", "nothing here"), ("q5", ""), ("q6", "w2 w2"), ("q7", "w0")]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        texts = [(g, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=rng.randint(0, 40))) if rng.random() < 0.8 else None) for g in ("a", "b")]
        rows.append((f"d{i:03}", None if i % 11 == 0 else 1.0 + (i * 37 % 101) ** 2, texts))
    rows += [("empty", 3.0, []), ("none", 2.0, None), ("split", 5.0, [("a", "x x x"), ("b", "x x")])]
    docs = spark.createDataFrame(rows, "d string, static double, texts array<struct<g:string,text:string>>").repartition(3)
    long = docs.select("d", F.explode("texts").alias("t")).select("t.g", "d", "t.text").where("text IS NOT NULL")
    return docs, postings.write(long, new_folder(spark, "index"), "g", "d", static=docs.select("d", "static").where("static IS NOT NULL"), per_block=16, tiers=4)


@pytest.mark.parametrize("k", [2, 400])
@pytest.mark.parametrize(("tokens", "block", "words"), [(1 << 21, 512, 1 << 15), (100, 16, 1 << 15), (1 << 21, 32, 3)])
def test_scan_equals_the_index(spark, made, monkeypatch, k, tokens, block, words):
    monkeypatch.setattr(blocks, "SLICE_TOKENS", tokens)
    monkeypatch.setattr(blocks, "DOCS", block)
    monkeypatch.setattr(postings, "MOST_WORDS", words)
    docs, index = made
    terms = score.query_terms(spark.createDataFrame(ASKED, "query_id string, query string"))
    phrases = spark.createDataFrame(PHRASES, "query_id string, phrase string")
    boost = F.when(F.col("g") == "a", 3.0).otherwise(0.5)
    best = lambda x: sorted(map(tuple, rank.top(x, ["query_id"], [F.col("score").desc(), F.col("d")], k).select("query_id", "d", "score").collect()))
    want = best(postings.search(index, terms, k, boost=boost, bonus=postings.phrase_scores(index, phrases), factors=True))
    assert best(postings.search_documents(docs, terms, phrases, k, NAMES, boost)) == want
    assert {q for q, *_ in want} == {"q1", "q2", "q3", "q4", "q6", "q7"}


def test_no_phrases_and_no_texts(spark, made):
    docs, _ = made
    terms = score.query_terms(spark.createDataFrame(ASKED, "query_id string, query string"))
    none = spark.createDataFrame([], "query_id string, phrase string")
    assert postings.search_documents(docs, terms, none, 3, NAMES).count() > 0
    assert postings.search_documents(docs.where("d = 'none'"), terms, none, 3, NAMES).count() == 0
    only = postings.search_documents(docs, terms.where("false"), spark.createDataFrame([("p", "w0 w1")], "query_id string, phrase string"), 3, NAMES)
    assert only.count() > 0 and only.columns == ["query_id", "d", "score"]


def test_raw_search_writes_no_index(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("an index is written")

    monkeypatch.setattr(retrieval, "write_fields", never)
    monkeypatch.setattr(retrieval, "fields_index", never)
    monkeypatch.setattr(postings, "write", never)
    assert registry.QUERIES["raw_search"](spark, SF).count() > 0


def test_documents_are_found_as_by_the_index(spark):
    index, queries = fixtures.index(spark, SF), fixtures.query_strings(spark, SF).select(F.col("n").cast("string").alias("query_id"), F.col("q").alias("query"))
    rows = lambda written: sorted(map(tuple, retrieval.full_text(index, queries, written=written).collect()))
    assert rows(None) == rows(retrieval.fields_index(spark, SF)) and rows(None)
