"""Queries of query analysis, filters, citations, documents and small functions with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import markup
from ..functions import text as T
from ..functions import values as V
from ..operators import filters as P
from ..operators import rank, score
from ..sources import fixtures, lexicon
from ..sources.fixtures import with_tables
from ..sources.lexicon import SAMPLE
from ..tables import table
from . import retrieval

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _strings(select: str, **more: str) -> str:
    return with_tables("strings", select, **more)


_SEP = "chr(31)"
WORDS = "list_filter(regexp_split_to_array({q}, '\\s+'), lambda t: t <> '')"
# merges as patterns over the parts joined by a separator
_KEYWORD = "regexp_replace({s}, '([^\\x1f]+)\\x1f([0-9]+)(\\x1f|$)', '\\1 \\2\\3', 'g')"
_COURT = "regexp_replace({s}, '\\x1f((?i:court|high|tribunal))\\b(?:$|)', ' \\1', 'g')"
_SPACED = "regexp_replace(q, '([0-9]{4})([a-zA-Z])', '\\1 \\2', 'g')"


@query(_strings(f"SELECT n, {_SPACED} AS spaced FROM strings"))
def citation_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", T.citation_spacing(F.col("q")).alias("spaced"))


SHAPE = f"""CASE WHEN regexp_matches({_SPACED}, '(?i)\\(?\\d{{4}}\\)?\\s*\\(?\\d*\\)?\\s*[A-Z]{{2,10}}\\s*\\d+') OR regexp_matches({_SPACED}, '(?i)\\bv(?:s\\.?|ersus)?\\.?\\s+\\w') THEN 'citation'
WHEN regexp_matches({_SPACED}, '(?i)\\b(?:section|sec\\.?|u/s|rule|article)\\s*\\d+[A-Za-z]*(?:\\(\\d+\\))?') THEN 'provision' ELSE 'plain' END"""


@query(_strings(f"SELECT n, {SHAPE} AS shape FROM strings"))
def query_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", T.query_shape(F.col("q")).alias("shape"))


_PARTS = f"array_to_string({WORDS.format(q='q')}, {_SEP})"


@query(_strings(f"SELECT n, replace({_KEYWORD.format(s=_PARTS)}, {_SEP}, '|') AS merged FROM strings"))
def merge_keyword_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(T.merge_keyword_number(T.words(F.col("q"))), "|").alias("merged"))


@query(_strings(f"SELECT n, replace({_COURT.format(s=_PARTS)}, {_SEP}, '|') AS merged FROM strings"))
def merge_court_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(T.merge_court_city(T.words(F.col("q"))), "|").alias("merged"))


_STOP = ", ".join(f"'{w}'" for w in sorted(SAMPLE.stopwords - SAMPLE.journals))


@query(_strings(f"SELECT n, array_to_string(list_filter({WORDS.format(q='q')}, lambda t: upper(t) NOT IN ({_STOP})), '|') AS kept FROM strings"))
def strip_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(T.strip_stopwords(T.words(F.col("q")), SAMPLE), "|").alias("kept"))


_QUOTED = f"""array_to_string(list_concat(regexp_extract_all(q, '"([^"]+)"', 1), {WORDS.format(q="regexp_replace(q, '\"([^\"]+)\"', ' ', 'g')")}), {_SEP})"""


@query(_strings(f"SELECT n, replace({_QUOTED}, {_SEP}, '|') AS parts FROM strings"))
def quoted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(T.quoted_phrases(F.col("q")), "|").alias("parts"))


PHRASES = f"list_filter(string_split({_COURT.format(s=_KEYWORD.format(s=_QUOTED))}, {_SEP}), lambda t: upper(t) NOT IN ({_STOP}) AND contains(t, ' '))"


@query(_strings(f"SELECT n, array_to_string({PHRASES}, '|') AS phrases FROM strings"))
def boost_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(T.boost_phrases(F.col("q"), SAMPLE), "|").alias("phrases"))


SYNONYMS = ", ".join(f"('{k}', {i}, '{s}')" for k, v in sorted(SAMPLE.synonyms.items()) for i, s in enumerate(v))


@query(
    _strings(
        """SELECT s.n, CASE WHEN x.extra IS NULL THEN s.q ELSE concat(s.q, ' ', x.extra) END AS expanded FROM strings s LEFT JOIN (
SELECT n, string_agg(syn, ' ' ORDER BY pos, i) AS extra FROM (SELECT w.n, y.syn, min(w.pos) AS pos, min(y.i) AS i FROM wordsof w JOIN syns y ON y.k = upper(w.t)
WHERE NOT EXISTS (SELECT 1 FROM wordsof o WHERE o.n = w.n AND upper(o.t) = upper(y.syn)) GROUP BY w.n, y.syn) GROUP BY n) x USING (n)""",
        wordsof=f"SELECT n, unnest({WORDS.format(q='q')}) AS t, generate_subscripts({WORDS.format(q='q')}, 1) AS pos FROM strings",
        syns=f"SELECT * FROM (VALUES {SYNONYMS}) v(k, i, syn)",
    )
)
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", T.expand_synonyms(F.col("q"), SAMPLE).alias("expanded"))


@query(
    _strings(
        f"SELECT n, t AS token, upper(t) IN ('AAR', 'HIGHCOURT', 'ITAT') AS is_court, upper(t) IN ('CTR', 'ITR', 'SCC') AS is_journal, upper(t) IN ({', '.join(repr(w) for w in sorted(SAMPLE.stopwords))}) AS is_stopword, CASE upper(t) WHEN '115I' THEN '115-I' WHEN '12A' THEN '12-A' ELSE t END AS normal FROM (SELECT n, unnest({WORDS.format(q='q')}) AS t FROM strings)"
    )
)
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixtures.query_strings(spark, sf_dir).select("n", F.explode(T.words(F.col("q"))).alias("token"))
    t = F.col("token")
    return words.select("n", "token", T.is_court(t, SAMPLE).alias("is_court"), T.is_journal(t, SAMPLE).alias("is_journal"), T.is_stopword(t, SAMPLE).alias("is_stopword"), T.normalised(t, SAMPLE).alias("normal"))


#: Rows of a lexicon made of each document's first words; the zones, synonyms and normal forms take turns.
_ROWS = """SELECT w AS key, CASE doc_id % 8 WHEN 0 THEN 'COURT|CITY' WHEN 1 THEN 'BENCH' WHEN 2 THEN 'JOURNAL' WHEN 3 THEN 'STOPWORD' WHEN 4 THEN 'COUNTRY' ELSE 'WORD' END AS z,
CASE doc_id % 8 WHEN 2 THEN w WHEN 4 THEN concat(w, '|', source) WHEN 5 THEN concat(w, ' | ', source, ' OF ', lang, ' | ') WHEN 6 THEN concat(' ', w, '-', source) WHEN 7 THEN concat(' ', lower(w), ' ') ELSE '' END AS st
FROM (SELECT doc_id, coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, concat(upper(regexp_extract(text, '[A-Za-z]+', 0)), CAST(doc_id AS STRING)) AS w FROM documents)"""


@query(
    f"""SELECT kind, key, CASE kind WHEN 'synonym' THEN array_to_string(list_filter(list_transform(string_split(s, '|'), lambda p: trim(p)), lambda p: p <> ''), ',') WHEN 'normal' THEN s ELSE '' END AS vals FROM (
SELECT key, trim(st) AS s, CASE WHEN contains(z, 'COURT') OR contains(z, 'BENCH') THEN 'court' WHEN z = 'JOURNAL' THEN 'journal' WHEN z = 'STOPWORD' THEN 'stopword' WHEN contains(z, 'COUNTRY') THEN NULL WHEN contains(trim(st), '|') THEN 'synonym' WHEN trim(st) <> '' AND upper(trim(st)) <> upper(key) THEN 'normal' END AS kind FROM ({_ROWS})) WHERE kind IS NOT NULL"""
)
def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_ROWS.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents")).toDF("key", "zone_type", "search_text")
    return lexicon.build(rows).select("kind", "key", F.array_join("values", ",").alias("vals"))


_PROTECTED = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '\\b[A-Za-z0-9][A-Za-z0-9()/-]*\\b'), lambda t: (regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]') AND length(t) >= 2) OR (regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]'))), lambda t: upper(t))))"


@query(_strings(f"SELECT n, array_to_string({_PROTECTED.format(x='q')}, ',') AS ids FROM strings"))
def protected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(F.array_sort(T.protected_identifiers(F.col("q"))), ",").alias("ids"))


_REWRITES = "CASE n % 4 WHEN 0 THEN concat(q, ' please') WHEN 1 THEN concat(q, ' under the CGST Act') WHEN 2 THEN replace(q, '2', '3') ELSE lower(q) END"
_MARKERS = list(T.LEGAL_MARKERS) + [c.lower() for c in T.KNOWN_COURTS]
_NUMBERS = "list_sort(list_distinct(regexp_extract_all({x}, '\\d+')))"
_PLAIN = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


@query(
    _strings(
        f"""SELECT n, CASE WHEN len(list_filter({_MARKERS}, lambda m: contains(lower(r), m) AND NOT contains(lower(q), m))) > 0 OR {_NUMBERS.format(x='q')} <> {_NUMBERS.format(x='r')}
OR len(list_filter({_PROTECTED.format(x='q')}, lambda m: NOT list_contains({_PROTECTED.format(x='r')}, m))) > 0
OR (len({_PLAIN.format(x='q')}) > 0 AND len(list_intersect({_PLAIN.format(x='q')}, {_PLAIN.format(x='r')})) / len({_PLAIN.format(x='q')}) < 0.6) THEN q ELSE r END AS kept FROM (SELECT n, q, {_REWRITES} AS r FROM strings)"""
    )
)
def safe_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = fixtures.query_strings(spark, sf_dir).withColumn("r", F.expr(_REWRITES))
    return rewritten.select("n", T.safe_rewrite(F.col("q"), F.col("r")).alias("kept"))


_FILTERS = "concat_ws('', CASE WHEN n % 2 = 0 THEN 'court=Supreme court;' ELSE 'court=Oslo High Court;' END, 'section=12A;', 'judge=Nobody;', 'colour=red;')"


@query(_strings("SELECT n, array_to_string(list_filter([CASE WHEN n % 2 = 0 THEN 'court=Supreme court' ELSE 'court=High Court' END, 'section=12A', 'judge=Nobody'], lambda p: contains(lower(q), lower(split_part(p, '=', 2)))), ';') AS kept FROM strings"))
def sanitize_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    court = F.when(F.col("n") % 2 == 0, "Supreme court").otherwise("High Court")
    given = F.create_map(F.lit("court"), court, F.lit("section"), F.lit("12A"), F.lit("judge"), F.lit("Nobody"), F.lit("colour"), F.lit("red"))
    kept = F.map_entries(P.sanitised(F.col("q"), given))
    return fixtures.query_strings(spark, sf_dir).select("n", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("kept"))


@query(_strings("SELECT n, contains(q, '2005') AS gte_kept, contains(q, '1975') AS lte_kept FROM strings"))
def sanitize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.create_map(F.lit("gte"), F.lit("2005-01-01"), F.lit("lte"), F.lit("1975-12-31"), F.lit("until"), F.lit("2005-01-01"))
    kept = P.sanitised_dates(F.col("q"), given)
    return fixtures.query_strings(spark, sf_dir).select("n", F.map_contains_key(kept, "gte").alias("gte_kept"), F.map_contains_key(kept, "lte").alias("lte_kept"))


_STOPS = ", ".join(f"'{w}'" for w in T.HIGHLIGHT_STOPWORDS)


@query(_strings(f"SELECT n, string_agg(w, ',' ORDER BY length(w) DESC, pos) AS terms FROM (SELECT n, w, min(pos) AS pos FROM (SELECT n, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+'), 1) AS pos FROM strings) WHERE length(w) >= 3 AND w NOT IN ({_STOPS}) GROUP BY n, w) GROUP BY n"))
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fixtures.query_strings(spark, sf_dir).select("n", T.query_terms(F.col("q")).alias("t"))
    return terms.where(F.size("t") > 0).select("n", F.array_join("t", ",").alias("terms"))


_MARKED = r"""WITH items AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS every FROM benchmark),
words AS (SELECT place, w, min(pos) AS pos FROM (SELECT place, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT place, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM items)) WHERE length(w) >= 3 AND w NOT IN (STOPS) GROUP BY place, w),
patterns AS (SELECT place, concat('(?i)\b(', string_agg(w, '|' ORDER BY length(w) DESC, pos), ')\b') AS p FROM words GROUP BY place),
marked AS (SELECT doc_id, regexp_replace(text, p, '<mark>\1</mark>', 'g') AS t FROM documents JOIN patterns ON place = doc_id % (SELECT any_value(every) FROM items))
SELECT doc_id, CAST((length(t) - length(replace(t, '<mark>', ''))) / 6 AS BIGINT) AS n_marks, md5(t) AS marked FROM marked""".replace("STOPS", _STOPS)


@query(_MARKED)
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of one benchmark text marked, in all languages; each text of the benchmark has its share of the documents."""
    from pyspark.sql import Window

    from ..functions import marks

    items = table(spark, sf_dir, "benchmark").select("text", "item_id").withColumn("n", F.row_number().over(Window.orderBy("item_id")) - 1)
    items = score.small(items.select(F.col("text").alias("query"), "n"))
    docs = table(spark, sf_dir, "documents").withColumn("n", F.col("doc_id") % items.count())
    shown = docs.join(items, "n").select("doc_id", marks.highlighted(F.col("text"), F.col("query")).alias("t"))
    return shown.select("doc_id", F.expr("CAST((length(t) - length(replace(t, '<mark>', ''))) / 6 AS BIGINT)").alias("n_marks"), F.md5("t").alias("marked"))


# ---- filters


def _index_ids(condition):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.index(spark, sf_dir).where(condition()).select(F.col("id").alias("doc_id"))

    return f


def _register(name: str, condition, where: str) -> None:
    QUERIES[name] = _index_ids(condition)
    ORACLES[name] = with_tables("ft_index", f"SELECT id AS doc_id FROM ft_index WHERE {where}")


_PAD = "concat(' ', array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), ' '), ' ')"
_register("filter_court", lambda: P.matches({"court": "Supreme Court"}), f"contains({_PAD.format(x='heading')}, ' sc ')")
_register("filter_court_fuzzy", lambda: P.matches({"court": "Delhi bench"}, True), "list_has_any(regexp_extract_all(lower(heading), '[\\p{L}\\p{N}]+'), ['delhi', 'bench'])")
_register("filter_section", lambda: P.matches({"section": " 40 "}), f"contains({_PAD.format(x='heading')}, ' section 40 ') OR contains({_PAD.format(x='heading')}, ' rule 40 ')")
_register("filter_act", lambda: P.matches({"act": "thatnd tionst"}), "list_has_any(regexp_extract_all(lower(fullcontent), '[\\p{L}\\p{N}]+'), ['thatnd', 'tionst'])")
_register("filter_judge", lambda: P.matches({"judge": "Judge7"}), "judge = 'Judge7'")
_register("filter_party_all", lambda: P.matches({"party": "Ltd Party 5"}), "list_has_all(regexp_extract_all(lower(subheading), '[\\p{L}\\p{N}]+'), ['ltd', 'party', '5'])")
_register("filter_date", lambda: P.matches({"date_range": {"gte": "2000-01-01", "lte": "2005-12-31"}}), "formatteddocumentdate BETWEEN DATE '2000-01-01' AND DATE '2005-12-31'")
_register("filter_conjunction", lambda: P.matches({"court": "Bombay High Court", "date_range": {"gte": "1995-06-01"}, "party": "party"}), f"contains({_PAD.format(x='heading')}, ' bombay ') AND formatteddocumentdate >= DATE '1995-06-01'")
_register("filter_blacklist", lambda: P.F.coalesce(F.col("landmarkruling") != -10, F.lit(True)), "coalesce(landmarkruling, 0) <> -10")

_REQUESTS = [("R1", "Supreme Court", None, None), ("R2", "Some Delhi place", None, None), ("R3", None, "40", None), ("R4", None, None, "Ltd Party 5"), ("R5", None, "99999", "no such party"), ("R6", "Nowhere", None, "ltd")]


@query(
    with_tables(
        "ft_index",
        f"""SELECT query_id, id AS doc_id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rn FROM (
SELECT 'R1' AS query_id, id FROM ft_index WHERE contains({_PAD.format(x="heading")}, ' sc ')
UNION ALL SELECT 'R2', id FROM ft_index WHERE list_has_any(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+'), ['some', 'delhi', 'place'])
UNION ALL SELECT 'R3', id FROM ft_index WHERE contains({_PAD.format(x="heading")}, ' section 40 ') OR contains({_PAD.format(x="heading")}, ' rule 40 ')
UNION ALL SELECT 'R3', id FROM ft_index WHERE list_has_any(regexp_extract_all(lower(heading), '[\\p{{L}}\\p{{N}}]+'), ['section', 'rule', '40']) AND NOT EXISTS (SELECT 1 FROM ft_index WHERE contains({_PAD.format(x="heading")}, ' section 40 ') OR contains({_PAD.format(x="heading")}, ' rule 40 '))
UNION ALL SELECT 'R4', id FROM ft_index WHERE list_has_all(regexp_extract_all(lower(subheading), '[\\p{{L}}\\p{{N}}]+'), ['ltd', 'party', '5']))) WHERE rn <= 1000""",
    )
)
def filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = spark.createDataFrame([(*r, None, None, None) for r in _REQUESTS], "query_id string, court string, section string, party string, judge string, date_from date, date_to date")
    return P.allowlists(fixtures.index(spark, sf_dir), requests)


@query(
    with_tables(
        "chunks ft_index",
        f"SELECT collection, CAST(count(*) AS BIGINT) AS n FROM chunks WHERE doc_id IN (SELECT id FROM ft_index WHERE contains({_PAD.format(x='heading')}, ' sc ')) GROUP BY collection",
    )
)
def allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = P.allowlist(fixtures.index(spark, sf_dir), {"court": "Supreme Court"}, most=None)
    inside = fixtures.chunks(spark, sf_dir).join(allowed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return inside.groupBy("collection").agg(F.count("*").alias("n"))


# ---- citations

_CITED = "list_distinct(list_filter(flatten(list_transform(regexp_extract_all(answer, '\\[([A-Za-z0-9_-]+(?:\\s*,\\s*[A-Za-z0-9_-]+)*)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda t: trim(t)))), lambda t: length(t) >= 2 AND regexp_matches(t, '[0-9]')))"


@query(with_tables("answers", f"SELECT answer_id, array_to_string(list_sort({_CITED}), ',') AS ids FROM answers"))
def cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.answers(spark, sf_dir).select("answer_id", F.array_join(F.array_sort(C.cited_ids(F.col("answer"))), ",").alias("ids"))


@query(with_tables("answers", f"SELECT answer_id, id FROM (SELECT answer_id, unnest({_CITED}) AS id FROM answers) WHERE id NOT IN (SELECT CAST(doc_id AS STRING) FROM documents WHERE doc_id % 2 = 0)"))
def invalid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = fixtures.answers(spark, sf_dir).select("answer_id", F.explode(C.cited_ids(F.col("answer"))).alias("id"))
    seen = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return cited.join(seen, "id", "left_anti").select("answer_id", "id")


@query(with_tables("answers", f"SELECT answer_id, len(list_filter({_CITED}, lambda t: t <> answer_id)) = 0 AS valid, list_contains({_CITED}, answer_id) AS gold_hit FROM answers"))
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    return fixtures.answers(spark, sf_dir).select("answer_id", C.citation_valid(a, F.array("answer_id")).alias("valid"), C.gold_cited(a, F.array("answer_id")).alias("gold_hit"))


_NUMBERED = "SELECT answer_id, id, min(p) AS first, count(*) AS n FROM (SELECT answer_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM (SELECT answer_id, flatten(list_transform(regexp_extract_all(answer, '\\[([A-Za-z0-9_]+(?:\\s*,\\s*[A-Za-z0-9_]+)*)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda t: trim(t)))) AS ids FROM answers)) GROUP BY answer_id, id"


@query(with_tables("answers", f"SELECT answer_id, id AS doc_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY first) AS BIGINT) AS number, CAST(n AS BIGINT) AS count FROM ({_NUMBERED})"))
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.answers(spark, sf_dir).select("answer_id", F.explode(C.numbers(F.col("answer"))).alias("c"))
    return rows.select("answer_id", "c.doc_id", F.col("c.number").cast("long").alias("number"), F.col("c.count").cast("long").alias("count"))


@query(with_tables("answers", "SELECT answer_id, regexp_replace(concat('**held** ** [', answer_id, '] **'), '\\*\\*\\s*(\\[[^\\]]+\\])\\s*\\*\\*', '\\1', 'g') AS clean FROM answers"))
def bold_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("**held** ** ["), F.col("answer_id"), F.lit("] **"))
    return fixtures.answers(spark, sf_dir).select("answer_id", C.strip_bold_brackets(text).alias("clean"))


@query()
def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array("answer_id", (F.col("answer_id").cast("long") + 1).cast("string"))
    parts = fixtures.answers(spark, sf_dir).select("answer_id", F.posexplode(C.segments(F.col("answer"), known)).alias("pos", "s"))
    return parts.select("answer_id", "pos", "s.type", "s.text", F.array_join(F.transform("s.numbers", lambda n: n.cast("string")), ",").alias("numbers"))


@query(with_tables("answers ft_index", f"SELECT a.answer_id, c.id AS doc_id, coalesce(nullif(i.heading, ''), c.id) AS label FROM answers a, (SELECT answer_id, unnest({_CITED}) AS id FROM answers) c LEFT JOIN ft_index i ON i.id = c.id WHERE a.answer_id = c.answer_id"))
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = fixtures.answers(spark, sf_dir).select("answer_id", F.explode(C.cited_ids(F.col("answer"))).alias("doc_id"))
    heads = fixtures.index(spark, sf_dir).select(F.col("id").alias("doc_id"), "heading")
    return cited.join(heads, "doc_id", "left").select("answer_id", "doc_id", F.coalesce(F.nullif("heading", F.lit("")), "doc_id").alias("label"))


@query(with_tables("answers ft_index", f"SELECT DISTINCT c.id AS doc_id, i.heading, i.year FROM (SELECT unnest({_CITED}) AS id FROM answers) c JOIN ft_index i ON i.id = c.id WHERE TRY_CAST(c.id AS BIGINT) % 2 = 1"))
def backfill_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of cited documents that were not fetched before (the even ones were)."""
    cited = fixtures.answers(spark, sf_dir).select(F.explode(C.cited_ids(F.col("answer"))).alias("doc_id")).distinct()
    index = fixtures.index(spark, sf_dir).select(F.col("id").alias("doc_id"), "doc_number", "heading", "year")
    fetched = index.where("doc_number % 2 = 0").select("doc_id")
    return cited.join(fetched, "doc_id", "left_anti").join(index, "doc_id").select("doc_id", "heading", "year")


# ---- lookups, documents, small functions


@query(with_tables("ft_index", "SELECT id AS doc_id, heading, subheading, year, judge FROM ft_index"))
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    index = fixtures.index(spark, sf_dir).select("id", "heading", "subheading", F.struct(F.col("year").alias("name")).alias("year"), F.array(F.struct(F.col("judge").alias("name"))).alias("judges"))
    return ids.join(index, "id", "left").select(F.col("id").alias("doc_id"), "heading", "subheading", F.col("year.name").alias("year"), F.col("judges")[0]["name"].alias("judge"))


@query(with_tables("answers ft_index", f"SELECT DISTINCT c.id AS doc_id, md5(coalesce(i.fullcontent, '')) AS content FROM (SELECT unnest({_CITED}) AS id FROM answers) c JOIN ft_index i ON i.id = c.id"))
def fulltext_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents that answers cite."""
    ids = fixtures.answers(spark, sf_dir).select(F.explode(C.cited_ids(F.col("answer"))).alias("id")).distinct()
    return fixtures.index(spark, sf_dir).join(ids, "id").select(F.col("id").alias("doc_id"), F.md5(F.coalesce("fullcontent", F.lit(""))).alias("content"))


@query("SELECT page_id, regexp_matches(lower(substr(ltrim(html), 1, 200)), '^(<!doctype html|<html)') AS legacy FROM pages")
def legacy_html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.is_legacy(F.col("html")).alias("legacy"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS stripped FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(markup.stripped(F.col("html"))).alias("stripped"))


@query()
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.blocks(F.col("html"))).alias("pos", "b"))
    return parsed.select("page_id", "pos", "b.type", F.array_join(F.col("b.spans.text"), "").alias("text"))


@query(
    "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\n{2,}'), lambda p: trim(p, ' ') <> '')) AS BIGINT) AS n, substr(text, 1, 200) AS preview, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...') ELSE text END AS clipped FROM documents"
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(t)).cast("long").alias("n"), T.preview(t).alias("preview"), T.clipped(t).alias("clipped"))


@query("SELECT page_id, trim(regexp_replace(url, '[^a-zA-Z0-9_-]+', '-', 'g'), '-') AS slug, sha256(html) AS digest, regexp_replace(replace(url, 'http', 'ws'), '^ws', 'http') AS address FROM pages")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.sha2("html", 256).alias("digest"), T.socket_url(F.replace("url", F.lit("http"), F.lit("ws"))).alias("address"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(concat('**', source, '** of **', lang, '** or *', lang, '*'), '\\*\\*.+?\\*\\*'), '|') AS bold FROM documents")
def bold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").na.fill("", ["source", "lang"])
    text = F.concat(F.lit("**"), "source", F.lit("** of **"), "lang", F.lit("** or *"), "lang", F.lit("*"))
    return docs.select("doc_id", F.array_join(T.bold_spans(text), "|").alias("bold"))


@query("SELECT event_id, round_even(value::DECIMAL(10,4) / 20, 1)::DOUBLE AS ms, CASE WHEN user_id > 50 THEN '>50' ELSE CAST(user_id AS STRING) END AS shown, CASE WHEN event_type = 'view' THEN 'N/A' ELSE printf('%+d', user_id - 10) END AS delta FROM events")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, ranks and differences as readers see them, of every event."""
    u = F.col("user_id")
    ms = (F.col("value").cast("decimal(10,4)") / 20).cast("decimal(14,6)")
    return table(spark, sf_dir, "events").select("event_id", V.rounded_ms(ms).cast("double").alias("ms"), V.shown_rank(F.when(u <= 50, u)).alias("shown"), V.shown_delta(u - 10, F.col("event_type") != "view").alias("delta"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN user_id END AS input, CASE WHEN event_type = 'click' THEN event_id END AS output, event_type = 'error' AND user_id % 2 = 0 OR event_type = 'purchase' AS equal,
CAST(CASE WHEN event_type = 'signup' THEN user_id ELSE event_id END AS BIGINT) AS merged FROM events"""
)
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage, equality and merging of maps made of every event's columns."""
    kind, u, e = F.col("event_type"), F.col("user_id"), F.col("event_id")
    tokens = F.when(kind == "view", F.create_map(F.lit("prompt_tokens"), u)).when(kind == "click", F.create_map(F.lit("prompt_tokens"), u, F.lit("completion_tokens"), e)).otherwise(F.create_map(F.lit("other"), u))
    a = F.create_map(F.lit("x"), u, F.lit("y"), e)
    b = F.when(kind == "purchase", F.create_map(F.lit("y"), e, F.lit("x"), u)).when(kind == "error", F.create_map(F.lit("y"), e, F.lit("x"), u + u % 2)).otherwise(F.create_map(F.lit("x"), u))
    merged = V.merged_maps(F.create_map(F.lit("k"), e), F.when(kind == "signup", F.create_map(F.lit("k"), u)).otherwise(F.create_map(F.lit("z"), u)))
    used = V.usage(tokens)
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(used, F.lit("input")).alias("input"), F.try_element_at(used, F.lit("output")).alias("output"), V.maps_equal(a, b).alias("equal"), F.element_at(merged, "k").alias("merged"))
