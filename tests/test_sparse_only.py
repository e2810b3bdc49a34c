"""Queries of one kind of list make no index of the other kind."""

import pytest

from docketlake.plans import registry, retrieval

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "unused"), [("collection_ranks", "coded_chunks"), ("first_collection", "coded_chunks"), ("first_unique_docs", "coded_chunks"), ("synthesis_prompts", "words_index")])
def test_other_index_is_not_written(spark, monkeypatch, name, unused):
    def never(*_):
        raise AssertionError(unused)

    monkeypatch.setattr(retrieval, unused, never)
    assert registry.QUERIES[name](spark, SF).columns
