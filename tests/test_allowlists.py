"""Allowlists by terms: the same documents as the filters' conditions give one by one."""

import itertools
import random

from pyspark.sql import functions as F

from docketlake.operators import filters
from docketlake.plans import retrieval

HEADINGS = ["[2020] 1 ITR 2 (SC)", "Section - 17D", "Rule - 17D", "[2019] 5 (Delhi)", "Section 17 D of Delhi", "Trib. Bench SC", "", None, "--"]
SUBS = ["A Ltd vs. B", "B Ltd A", "Traders", None]
TEXTS = ["gift tax act", "income", "GIFT", None]
JUDGES = [["J One"], ["J Two", "K One"], [], ["J One", "J Three"]]
DATES = ["2001-01-01", "2001-01-31", "2010-05-05", None]


def made(spark):
    rng = random.Random(2)
    rows = [(f"{i:03}", rng.choice(HEADINGS), rng.choice(SUBS), rng.choice(TEXTS), rng.choice(JUDGES), rng.choice(DATES)) for i in range(150)]
    return spark.createDataFrame(rows, "id string, heading string, subheading string, fullcontent string, judges array<string>, d string").withColumn("formatteddocumentdate", F.col("d").cast("date"))


REQUESTS = [
    {"court": "Supreme Court"}, {"court": "Delhi High Court", "bench": "SC"}, {"bench": "Bench"}, {"section": "17D"}, {"section": " 17 "}, {"section": "99", "judge": "Nobody One"}, {"act": "gift act"}, {"judge": "J One"}, {"judge": "Three"},
    {"party": "b ltd"}, {"party": "ltd", "act": "gift"}, {"court": "--"}, {"act": "--"}, {"date_range": {"gte": "2001-01-15"}}, {"date_range": {"lte": "2001-01-31"}}, {"date_range": {"gte": "2001-01-01", "lte": "2009-12-31"}, "judge": "J One"},
    {"date_range": {"gte": "2050-01-01"}}, {"court": "Delhi nowhere"}, {"court": "zzz", "party": "traders"}, {"party": "no such"},
]


def test_batches_give_what_each_filter_gives(spark):
    index = made(spark)
    rows = []
    for i, r in enumerate(REQUESTS):
        dates = r.get("date_range", {})
        rows.append((f"q{i}", *(r.get(k) for k in filters.REQUEST[:6]), dates.get("gte"), dates.get("lte")))
    rows.append(("none", *[None] * 8))
    asked = spark.createDataFrame(rows, "query_id string, " + ", ".join(f"{k} string" for k in filters.REQUEST))
    for k in ("date_from", "date_to"):
        asked = asked.withColumn(k, F.col(k).cast("date"))
    want = {f"q{i}": sorted(r.id for r in filters.allowlist(index.where("heading IS NULL OR heading <> '--'") if r in ({"court": "--"},) else index, r).collect()) for i, r in enumerate(REQUESTS)}
    want["q11"] = []  # a value without words is in no heading
    fields = retrieval.postings.write(retrieval.score.fields_long(index.withColumns({c: F.lit(None).cast("string") for c in ("facts_text", "held_text", "headnotes_text")})), retrieval.new_folder(spark, "fields"), "field", "doc_id")
    for written in (None, fields):
        got = {}
        for r in filters.allowlists(index, asked, written=written).collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert sum(map(bool, want.values())) > 12
    plan = filters.allowlists(index, asked, written=fields)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_most_and_parties_without_words(spark):
    index = made(spark)
    asked = spark.createDataFrame([("p", "--"), ("t", "traders")], "query_id string, party string")
    got = [(r.query_id, r.doc_id) for r in filters.allowlists(index, asked, most=7).orderBy("query_id", "doc_id").collect()]
    traders = [r.id for r in index.where("lower(subheading) = 'traders'").orderBy("id").limit(7).collect()]
    assert got == [*(("p", f"{i:03}") for i in range(7)), *(("t", i) for i in traders)]
    assert list(itertools.islice(got, 1)) == [("p", "000")]


def test_all_matches_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_PUSHED", 1)  # the terms are joined
    index = made(spark)
    asked = spark.createDataFrame([("p", "--"), ("t", "traders ltd"), ("t2", "traders")], "query_id string, party string")
    got = sorted((r.query_id, r.doc_id) for r in filters.allowlists(index, asked, most=None).collect())
    traders = [r.id for r in index.where("lower(subheading) = 'traders'").orderBy("id").collect()]
    assert got == [*(("p", f"{i:03}") for i in range(150)), *(("t2", i) for i in traders)]
