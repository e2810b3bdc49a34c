"""Query op7: remove from documents the lines that stand in many sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines
from ._common import documents


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH pieces AS (
  SELECT doc_id, source, pos, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), boilerplate AS (
  SELECT bare FROM pieces WHERE bare <> '' AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= {lines.MIN_SITES}
), rebuilt AS (
  SELECT doc_id, count(b.bare) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.bare IS NULL), '') AS text
  FROM pieces LEFT JOIN boilerplate b USING (bare) GROUP BY doc_id
)
SELECT doc_id, removed_lines, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM rebuilt
"""
