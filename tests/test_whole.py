"""Queries over all rows: none is left out by its number, and none runs on made-up rows alone."""

import pytest

from docketlake.operators import score
from docketlake.plans import registry
from docketlake.sources import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_no_sql_is_restricted_or_without_a_table(name):
    sql = registry.ORACLES[name]
    assert not any(r in sql for r in ("item_id < ", "vec_id < ", "doc_number < ", "event_id % 50", "range(500)", "FROM range("))
    assert any(t in sql for t in TABLES)


@pytest.mark.parametrize("name", ["dense_topk", "sparse_bm25_topk", "rrf_chunk", "rrf_doc_3src", "multi_field_bm25", "instant", "ai_mode", "evaluation_run", "agent_run"])
def test_every_query_has_rows(spark, name):
    asked = {r.query_id for r in fixtures.queries(spark, SF).select("query_id").collect()}
    assert len(asked) > 8
    assert {r.query_id for r in registry.QUERIES[name](spark, SF).select("query_id").distinct().collect()} == asked


def test_fuzzy_terms_of_every_query(spark):
    asked = {r.term for r in score.query_terms(fixtures.queries(spark, SF)).select("term").distinct().collect()}
    assert {r.term for r in registry.QUERIES["fuzzy_terms"](spark, SF).select("term").distinct().collect()} == asked
