"""Query op13: spelling variants of the words of documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spelling
from ._common import documents


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), runs AS (
  SELECT doc_id, run, count(*) AS n, concat(doc_id, ':', run) AS s FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc
), spoilt AS (
  SELECT CASE WHEN h % {spelling.SPOIL} = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
), places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
replaced AS (SELECT word, concat(left(word, i), '*', substr(word, i + 2)) AS p FROM places),
deleted AS (SELECT DISTINCT word, concat(left(word, i), substr(word, i + 2)) AS p FROM places),
near AS (
  SELECT a.word, b.word AS other FROM replaced a JOIN replaced b USING (p) WHERE a.word <> b.word
  UNION ALL SELECT d.word, w.word FROM deleted d JOIN words w ON w.word = d.p UNION ALL SELECT w.word, d.word FROM deleted d JOIN words w ON w.word = d.p
), ranked AS (SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS r FROM near JOIN words ON words.word = other),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {spelling.RATIO} * w.n THEN other END AS form, CASE WHEN r.n >= {spelling.RATIO} * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain AS (SELECT word, word AS top FROM formed UNION SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.top WHERE form IS NOT NULL)
SELECT f.word, f.form, top AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f JOIN chain ON chain.word = f.word WHERE top IN (SELECT word FROM formed WHERE form IS NULL)
"""
