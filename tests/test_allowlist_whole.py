"""allowlist_semi over more matches than an allowlist holds by default."""

import duckdb

from docketlake.operators import filters
from docketlake.plans import registry


def test_allowlist_semi_counts_all_matches(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id * 9 AS doc_id", "concat('a', chr(10), 'b') AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["allowlist_semi"]).fetchall()
    got = registry.QUERIES["allowlist_semi"](spark, str(tmp_path)).collect()
    assert sorted((r.collection, r.n) for r in got) == sorted(want)
    assert dict(want)["metadata"] > filters.MOST


def test_allowlist_modes_counts_all_matches(spark, tmp_path):
    spark.range(1500).selectExpr("id * 2 AS doc_id", "concat('Gift ', if(id < 1200, 'rare', 'tax')) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "gift of land"), (2, "rare gifts"), (3, "nowhere else")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["allowlist_modes"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["allowlist_modes"](spark, str(tmp_path)).collect())) == sorted(want) == [("B1", "applied", 1500), ("B2", "applied", 1200), ("B3", "empty_ignored", 0)]
