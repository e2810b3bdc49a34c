"""Query op12: the documents that rank highest for each benchmark item, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import impact
from ._common import documents


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return impact.search(documents(spark, sf_dir).select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
postings AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term, nd),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {impact.K}
"""
