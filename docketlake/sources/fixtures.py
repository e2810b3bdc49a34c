"""Index, chunk and query tables derived from the test tables, with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contain import containing
from ..operators.score import MOST_NARROW, small
from ..storage import kept
from ..tables import table

#: Collections in the order in which lists are merged; the sparse ones are all but ``ruling``.
COLLECTIONS = ("case_summary", "digest", "headnotes", "facts", "held", "ruling", "metadata")
#: Documents, by number, that are numbered together.
RANGE = 4096
SPARSE = tuple(c for c in COLLECTIONS if c != "ruling")

_INDEX = """
SELECT CAST(doc_id AS STRING) AS id, doc_id AS doc_number,
       CASE WHEN doc_id % 7 = 3 THEN concat('Section - ', CAST(doc_id % 300 AS STRING))
            WHEN doc_id % 7 = 5 THEN concat('Rule - ', CAST(doc_id % 300 AS STRING))
            ELSE concat('[', CAST(1990 + doc_id % 35 AS STRING), '] ', CAST(doc_id % 200 AS STRING), ' ITR ',
                        CAST(doc_id AS STRING), ' (',
                        CASE doc_id % 9 WHEN 0 THEN 'SC' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Bombay' WHEN 3 THEN 'Madras'
                             WHEN 4 THEN 'Calcutta' WHEN 5 THEN 'Karnataka' WHEN 6 THEN 'Gujarat' WHEN 7 THEN 'Trib.'
                             ELSE 'CESTAT' END, ')') END AS heading,
       concat('Party ', CAST(doc_id % 97 AS STRING), ' Ltd vs. Party ', CAST(doc_id % 89 AS STRING)) AS subheading,
       text AS fullcontent,
       CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 400) END AS facts_text,
       CASE WHEN doc_id % 4 = 1 THEN substr(text, 401, 400) END AS held_text,
       CASE WHEN doc_id % 5 < 3 THEN substr(text, 1, 200) END AS headnotes_text,
       CAST((doc_id * 37) % 10001 AS DOUBLE) AS documenttypeboost,
       CASE WHEN doc_id % 97 <> 0 THEN CAST((doc_id * 13) % 295 AS DOUBLE) END AS court_boost,
       CASE WHEN doc_id % 100 = 50 THEN CAST(-10 AS DOUBLE)
            WHEN doc_id % 50 = 0 THEN CAST(doc_id % 21 AS DOUBLE) END AS landmarkruling,
       {date} AS formatteddocumentdate,
       concat('Judge', CAST(doc_id % 23 AS STRING)) AS judge,
       CAST(2000 + doc_id % 24 AS STRING) AS year,
       CASE doc_id % 3 WHEN 0 THEN 'SC' WHEN 1 THEN 'Delhi' ELSE 'Trib.' END AS court,
       concat('Bench ', CAST(doc_id % 5 AS STRING)) AS bench,
       CASE WHEN doc_id % 6 <> 0 THEN concat('Party ', CAST(doc_id % 97 AS STRING)) END AS partyname
FROM documents
"""
_CHUNK_COLLECTION = "CASE (doc_id + pos) % 6 WHEN 0 THEN 'case_summary' WHEN 1 THEN 'digest' WHEN 2 THEN 'headnotes' WHEN 3 THEN 'facts' WHEN 4 THEN 'held' ELSE 'ruling' END"
#: A query string of one of thirteen shapes for each benchmark text, with words of the text.
_STRINGS = """
SELECT item_id AS n, CASE item_id % 13
         WHEN 0 THEN concat(CAST(1990 + item_id % 35 AS STRING), ' KLM ', CAST(item_id AS STRING), ' ', a, ' renewal')
         WHEN 1 THEN concat(CAST(1990 + item_id % 35 AS STRING), 'klmnotes ', CAST(item_id AS STRING))
         WHEN 2 THEN concat('Rule ', CAST(item_id % 300 AS STRING), ' late ', a, ' of a ', b)
         WHEN 3 THEN concat(a, ' Board v. ', b, ' Shipping')
         WHEN 4 THEN concat('from ', CAST(1970 + item_id % 50 AS STRING), ' to ', CAST(1975 + item_id % 50 AS STRING))
         WHEN 5 THEN concat('is a ', a, ' ticket a contract of ', b)
         WHEN 6 THEN concat('Clause ', CAST(item_id AS STRING), ' with "', a, ' ', b, '" in case of Supreme court')
         WHEN 7 THEN concat(a, ' High Court order on ', b)
         WHEN 8 THEN concat('u/s 12A ', a)
         WHEN 9 THEN concat('the number 12A of ', a, ' alone')
         WHEN 10 THEN concat('ACIT letter on ', b)
         WHEN 11 THEN concat('Rule ', CAST(item_id % 30 AS STRING), ' ', CAST(item_id % 7 AS STRING), ' of High Court Tribunal ', a)
         ELSE concat('ACIT v. CIT under Article ', CAST(item_id AS STRING), ' of the CGST Act ', CAST(2000 + item_id % 20 AS STRING)) END AS q
FROM (SELECT item_id, regexp_extract(text, '[A-Za-z]+', 0) AS a, regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) AS b FROM benchmark)
"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index: one row per document, with its citation metadata nested as in an index."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_INDEX.format(date="date_add(DATE '1990-01-01', CAST((doc_id * 11) % 12000 AS INT))")).withColumn("judges", F.array("judge")).withColumns(
        {
            "masterinfo": F.struct(F.array("heading").alias("citations"), F.struct("court", "bench").alias("info")),
            "otherinfo": F.struct("judge", "partyname"),
        }
    )


def collection_order() -> Column:
    """The place of ``collection`` in the order in which lists are merged."""
    return F.array_position(F.array(*map(F.lit, COLLECTIONS)), F.col("collection")).cast("int") - 1


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in six collections, and one row per document in ``metadata``."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("collection", F.expr(_CHUNK_COLLECTION))
    own = lines.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), "collection", F.col("pos").cast("string")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        "collection",
        F.col("pos").cast("int").alias("chunk_part"),
        F.col("line").alias("text"),
    )
    heads = index(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.lit("metadata").alias("collection"), F.lit(None).cast("int").alias("chunk_part"), F.concat_ws(" ", "heading", "subheading").alias("text"))
    return own.unionByName(heads).withColumn("collection_ord", collection_order())


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that have a vector: those whose number, in order of document and part, is a vector's.

    A document's chunks are numbered within it, and documents by the sizes of those before them: sums over ranges of
    documents of a bounded number come first, so that no window holds more than a range's documents, or one row for each range.
    The sizes are counted in the documents' rows, and texts are shuffled of those documents alone whose numbers lie between the vectors' first and last.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    low, high = vectors.agg(F.min("vec_id"), F.max("vec_id")).first()
    lines = F.greatest(F.size(F.split("text", "\n")), F.lit(0))
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    sizes = docs.groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.sum(lines + 1).alias("n")).withColumn("span", F.floor(F.col("d") / RANGE))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("n").over(earlier().orderBy("span")), F.lit(0)).alias("base"))
    starts = sizes.join(spans, "span").select("d", "n", (F.col("base") + F.coalesce(F.sum("n").over(earlier("span").orderBy("d")), F.lit(0))).alias("start"))
    needed = kept(starts.where((F.col("start") <= F.lit(high)) & (F.col("start") + F.col("n") > F.lit(low))).select("d", "start"))
    own = F.row_number().over(Window.partitionBy("d").orderBy(F.coalesce("chunk_part", F.lit(-1))))
    every = chunks(spark, sf_dir).withColumn("d", F.col("doc_id").cast("long")).join(small(needed, MOST_NARROW), "d")
    numbered = every.withColumn("own", own).withColumn("vec_id", F.col("start") + F.col("own") - 1)
    return numbered.join(vectors, "vec_id").drop("vec_id", "own", "start", "d")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query (first twelve tokens of a benchmark text), class, pass_at."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("B"), item.cast("string")).alias("query_id"),
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 12), " ").alias("query"),
        F.when(item % 3 == 0, "direct").when(item % 3 == 1, "indirect").otherwise("adversarial").alias("class"),
        F.when(item % 3 == 0, 5).when(item % 3 == 1, 10).otherwise(20).alias("pass_at"),
        "item_id",
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id: documents that hold a benchmark text."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return containing(docs, items, "doc_id", "text", "passage")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector: the vectors with the queries' numbers."""
    vectors = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return vectors.select(F.concat(F.lit("B"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))


def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, q: a query string for each benchmark text."""
    return spark.sql(_STRINGS.replace("FROM benchmark", "FROM {items}"), items=table(spark, sf_dir, "benchmark"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, answer: one made-up answer with good and bad citations per document."""
    d = F.col("doc_id")
    text = F.concat(F.lit("Held in ["), d.cast("string"), F.lit("] and ["), (d + 1).cast("string"), F.lit(", x"), d.cast("string"), F.lit("] but [sic] [1] [emphasis added]."))
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("answer_id"), text.alias("answer"))


# ---- the same tables as DuckDB SQL

SQL = {
    "ft_index": _INDEX.format(date="DATE '1990-01-01' + CAST((doc_id * 11) % 12000 AS INT)"),
    "chunks": f"""
SELECT concat(CAST(doc_id AS STRING), '::', collection, '::', CAST(pos AS STRING)) AS chunk_id, CAST(doc_id AS STRING) AS doc_id, collection, CAST(pos AS INT) AS chunk_part, line AS text,
       list_position({list(COLLECTIONS)}, collection) - 1 AS collection_ord
FROM (SELECT doc_id, pos, line, {_CHUNK_COLLECTION} AS collection
      FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
UNION ALL SELECT id, id, 'metadata', NULL, concat(heading, ' ', subheading), 6 FROM ft_index""",
    "hybrid": """
SELECT c.*, e.embedding FROM (SELECT *, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), coalesce(chunk_part, -1)) - 1 AS ord FROM chunks) c
JOIN embeddings e ON e.vec_id = c.ord""",
    "queries": r"""
SELECT concat('B', item_id) AS query_id, array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1, 12), ' ') AS query,
       CASE item_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'adversarial' END AS class,
       CASE item_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 20 END AS pass_at, item_id
FROM benchmark""",
    "gold": "SELECT concat('B', b.item_id) AS query_id, CAST(d.doc_id AS STRING) AS doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "vectors": "SELECT concat('B', vec_id) AS query_id, embedding AS vector FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)",
    "strings": _STRINGS,
    "answers": "SELECT CAST(doc_id AS STRING) AS answer_id, concat('Held in [', doc_id, '] and [', doc_id + 1, ', x', doc_id, '] but [sic] [1] [emphasis added].') AS answer FROM documents",
}
_NEEDS = {"chunks": ["ft_index"], "hybrid": ["chunks"]}


def with_tables(names: str, select: str, **more: str) -> str:
    """SELECT over the named tables and further ones given as SQL, in one statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n].strip()})" for n in order] + [f"{n} AS ({s.strip()})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {select.strip()}"
