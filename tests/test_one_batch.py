"""A batch of allowlists is no reason to write an index of all texts."""

import pytest
from pyspark.sql import functions as F

from docketlake.operators import filters
from docketlake.plans import registry, retrieval

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["filter_fallback", "allowlist_modes", "ai_mode"])
def test_allowlists_write_no_index_of_fields(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("an index of all fields")

    monkeypatch.setattr(retrieval, "write_fields", refuse)
    monkeypatch.setattr(spark.sparkContext, "_docketlake_indexes", {}, raising=False)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_only_asked_fields_are_taken_apart(spark):
    index = spark.createDataFrame([("1", "A (SC)", "x", "long text", ["J"], None)], "id string, heading string, subheading string, fullcontent string, judges array<string>, formatteddocumentdate date")
    # reading what is not asked for raises an error
    index = index.withColumn("fullcontent", F.raise_error(F.lit("read"))).withColumn("judges", F.array(F.raise_error(F.lit("read")).cast("string")))
    asked = spark.createDataFrame([("q", "Supreme Court")], "query_id string, court string")
    held = filters._held(index, filters._asked(asked.withColumns({c: F.lit(None).cast("string") for c in filters.REQUEST[1:6]}), False), None)
    assert [tuple(r) for r in held.collect()] == [("heading", "sc", "1")]
