"""Chunks that have a vector: the same as by numbering all chunks, without a shuffle of the texts of documents that have none."""

import duckdb
from pyspark.sql import functions as F

from docketlake.operators import codes
from docketlake.sources import fixtures
from docketlake.sources.fixtures import with_tables


def tables(spark, folder, vec_ids):
    docs = [(i * 37 % 9001, None if i % 11 == 0 else "\n".join(f"line {i} {j}" for j in range(i % 6)), "en", "s", 1) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(v, [float(v), 1.0]) for v in vec_ids], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def check(spark, folder):
    base = duckdb.connect()
    for name in ("documents", "embeddings"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    want = base.execute(with_tables("hybrid", "SELECT chunk_id, embedding FROM hybrid")).fetchall()
    found = fixtures.hybrid_chunks(spark, str(folder))
    assert sorted((r.chunk_id, list(r.embedding)) for r in found.select("chunk_id", "embedding").collect()) == sorted((c, list(e)) for c, e in want)
    return found, len(want)


def test_few_vectors_shuffle_few_texts(spark, tmp_path):
    tables(spark, tmp_path, range(100, 140))
    found, n = check(spark, tmp_path)
    assert n == 40
    # the documents are told apart below the window that numbers chunks, before texts are shuffled
    plan = found._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("row_number") :]
    assert "BroadcastHashJoin" in below[: below.index("Generate")]


def test_scattered_vectors_and_none(spark, tmp_path):
    for name, ids in (("scattered", [0, 3, 500, 700, 10**9]), ("none", [])):
        tables(spark, tmp_path / name, ids)
        assert check(spark, tmp_path / name)[1] == (4 if ids else 0)


def test_what_is_near_is_broadcast_to_the_vectors(spark):
    chunks = spark.createDataFrame([(f"c{i}", "l", [float(i % 17), float(i % 5), 1.0]) for i in range(200)], "chunk_id string, collection string, embedding array<double>")
    queries = spark.createDataFrame([("q1", [1.0, 0.0, 0.0]), ("q2", [0.0, 1.0, -1.0])], "query_id string, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = codes.best(chunks, queries, 3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.groupBy("query_id").agg(F.max("score").alias("s")).orderBy("query_id").collect()[0].s == 16.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
