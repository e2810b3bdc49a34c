"""Document filters: predicates on the index, the allowlist with its fallback, and the semi-join that applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import kept
from .postings import Index
from .rank import top
from .score import MOST_PUSHED, padded, small

# Abbreviations of courts in headings; filters; the most hits of an allowlist.
COURTS = {
    "supreme court": "SC",
    "delhi high court": "Delhi",
    "bombay high court": "Bombay",
    "madras high court": "Madras",
    "calcutta high court": "Calcutta",
    "karnataka high court": "Karnataka",
    "gujarat high court": "Gujarat",
    "income tax appellate tribunal": "Trib.",
    "customs excise and service tax appellate tribunal": "CESTAT",
}
KEYS = ("court", "bench", "section", "act", "judge", "party", "date_range")
FALLBACK = ("court", "bench", "section", "judge")
MOST = 1000


def heading_term(value: Column) -> Column:
    """The abbreviation of a court, or the value unchanged."""
    table = F.create_map(*(F.lit(x) for kv in COURTS.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.trim(value))), value)


def phrase_in(text: Column, phrase: Column) -> Column:
    return padded(text).contains(padded(phrase))


def any_term(text: Column, terms: Column) -> Column:
    return F.arrays_overlap(T.tokens(F.coalesce(text, F.lit(""))), T.tokens(terms))


def all_terms(text: Column, terms: Column) -> Column:
    return F.size(F.array_except(T.tokens(terms), T.tokens(F.coalesce(text, F.lit(""))))) == 0


def court_is(heading: Column, value: Column, fuzzy: bool = False) -> Column:
    return (any_term if fuzzy else phrase_in)(heading, heading_term(value))


def section_is(heading: Column, value: Column, fuzzy: bool = False) -> Column:
    match = any_term if fuzzy else phrase_in
    return match(heading, F.concat(F.lit("Section - "), F.trim(value))) | match(heading, F.concat(F.lit("Rule - "), F.trim(value)))


def judge_is(judges: Column, value: Column, fuzzy: bool = False) -> Column:
    """Some judge is exactly the value; fuzzy: has a term of it."""
    return F.exists(judges, lambda j: any_term(j, value) if fuzzy else j == value)


def between_dates(date: Column, first: Column, last: Column) -> Column:
    """Within the bounds that are given."""
    return (first.isNull() | (date >= first)) & (last.isNull() | (date <= last))


def matches(filters: dict, fuzzy: bool = False) -> Column:
    """The conjunction of the filters over the index's columns (heading, fullcontent, judges, subheading, formatteddocumentdate).

    A date range that is not an object with a bound is left out; without any known filter it raises ValueError.
    """
    parts = []
    for key in ("court", "bench"):
        if key in filters:
            parts.append(court_is(F.col("heading"), F.lit(filters[key]), fuzzy))
    if "section" in filters:
        parts.append(section_is(F.col("heading"), F.lit(filters["section"]), fuzzy))
    if "act" in filters:
        parts.append(any_term(F.col("fullcontent"), F.lit(filters["act"])))
    if "judge" in filters:
        parts.append(judge_is(F.col("judges"), F.lit(filters["judge"]), fuzzy))
    if "party" in filters:
        parts.append(all_terms(F.col("subheading"), F.lit(filters["party"])))
    dates = filters.get("date_range")
    if isinstance(dates, dict) and ("gte" in dates or "lte" in dates):
        bound = lambda k: F.lit(dates.get(k)).cast("date")
        parts.append(between_dates(F.col("formatteddocumentdate"), bound("gte"), bound("lte")))
    if not parts:
        raise ValueError(f"no known filter among {sorted(filters)}")
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def allowlist(index: DataFrame, filters: dict, most: int | None = MOST) -> DataFrame | None:
    """id of the documents that meet the filters, ``most`` at most, by id (all if it is None); None without filters.

    If none meets them and a filter has a looser form, the looser forms decide.
    """
    if not filters:
        return None
    first = lambda ids: ids if most is None else ids.orderBy("id").limit(most)
    strict = first(index.where(matches(filters)).select("id"))
    if not any(k in filters for k in FALLBACK):
        return strict
    if strict.limit(1).count():
        return strict
    return first(index.where(matches(filters, True)).select("id"))


#: Columns of a batch of requests; null where a filter is not asked for.
REQUEST = ("court", "bench", "section", "act", "judge", "party", "date_from", "date_to")


def requests_of(read: DataFrame) -> DataFrame:
    """query_id and the columns of REQUEST from queries with ``filters`` and ``dates`` (maps)."""
    named = [F.try_element_at("filters", F.lit(k)).alias(k) for k in REQUEST[:6]]
    bounds = [F.try_element_at("dates", F.lit(k)).try_cast("date").alias(n) for k, n in (("gte", "date_from"), ("lte", "date_to"))]
    return read.select("query_id", *named, *bounds)


def _asked(requests: DataFrame, loose: bool) -> DataFrame:
    """query_id, pred, alt, field, need, phrase, term: the terms that requests look for; a predicate is met by any of its alternatives.

    An alternative is met by a document that holds ``need`` of its terms in the field, and its phrase, if it has one.
    """
    section = lambda name: T.tokens(F.concat(F.lit(f"{name} - "), F.trim("section")))
    rows = []

    def add(pred: str, alt: int, field: str, terms: Column, how: str) -> None:
        need = F.lit(1) if how == "any" else F.size(F.array_distinct(terms))
        phrase = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")) if how == "phrase" else F.lit(None).cast("string")
        rows.append(F.when(F.col(pred).isNotNull(), F.struct(F.lit(pred).alias("pred"), F.lit(alt).alias("alt"), F.lit(field).alias("field"), need.alias("need"), phrase.alias("phrase"), F.array_distinct(terms).alias("terms"))))

    heading = "any" if loose else "phrase"
    add("court", 0, "heading", T.tokens(heading_term(F.col("court"))), heading)
    add("bench", 0, "heading", T.tokens(heading_term(F.col("bench"))), heading)
    add("section", 0, "heading", section("Section"), heading)
    add("section", 1, "heading", section("Rule"), heading)
    add("act", 0, "fullcontent", T.tokens(F.col("act")), "any")
    add("party", 0, "subheading", T.tokens(F.col("party")), "all")
    add("judge", 0, *(("judge", T.tokens(F.col("judge"))) if loose else ("judge is", F.array("judge"))), "any")
    each = requests.select("query_id", F.explode(F.array(*rows)).alias("r")).where("r IS NOT NULL").select("query_id", "r.*")
    return each.select("query_id", "pred", "alt", "field", "need", "phrase", F.explode("terms").alias("term"))


def _held(index: DataFrame, asked: DataFrame, written: Index | None) -> DataFrame:
    """field, term, doc_id: the asked terms in the fields of documents, from the written index where there is one; and in the judges' names.

    Without a written index documents are scanned once, and only the fields that are asked for are taken apart; of few asked terms a document's row
    keeps its own.
    """
    terms = kept(asked.select("field", "term").distinct())
    wanted = {r.field for r in terms.select("field").distinct().collect()}  # five at most
    judges = index.select(F.col("id").alias("doc_id"), F.explode("judges").alias("j")).where("j IS NOT NULL")
    parts = []
    if "judge is" in wanted:
        parts.append(judges.select(F.lit("judge is").alias("field"), F.col("j").alias("term"), "doc_id"))
    if "judge" in wanted:
        parts.append(judges.select(F.lit("judge").alias("field"), F.explode(T.tokens(F.col("j"))).alias("term"), "doc_id"))
    texts = [f for f in ("heading", "subheading", "fullcontent") if f in wanted]
    if written is not None and texts:
        parts.append(written.named(written.postings(terms).select(written.group, "term", "block", F.explode("at").alias("at"))).select(F.col(written.group).alias("field"), "term", F.col(written.doc).alias("doc_id")))
    elif texts:
        few = [r.term for r in terms.select("term").distinct().limit(MOST_PUSHED + 1).collect()]
        own = lambda f: F.array_distinct(F.filter(T.tokens(F.col(f)), lambda t: t.isin(few)) if len(few) <= MOST_PUSHED else T.tokens(F.col(f)))
        fields = F.array(*(F.struct(F.lit(f).alias("field"), own(f).alias("terms")) for f in texts))
        parts.append(index.select(F.col("id").alias("doc_id"), F.explode(fields).alias("f")).select("f.field", F.explode("f.terms").alias("term"), "doc_id"))
    if not parts:
        return index.select(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("term"), F.col("id").alias("doc_id")).limit(0)
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    return held.join(small(terms), ["field", "term"], "left_semi")


def _matched(index: DataFrame, requests: DataFrame, loose: bool, written: Index | None) -> DataFrame:
    """query_id, doc_id: the documents that meet all predicates of each request but its dates; requests without any have no row."""
    asked = _asked(requests, loose)
    # one shuffle, by query and document, serves all that is counted of both
    each = _held(index, asked, written).join(small(asked), ["field", "term"]).repartition("query_id", "doc_id").distinct()
    hits = there = each.groupBy("query_id", "pred", "alt", "need", "phrase", "doc_id").agg(F.count("*").alias("_n")).where("_n >= need")
    if not asked.where("phrase IS NOT NULL").isEmpty():
        lines = index.select(F.col("id").alias("doc_id"), padded(F.col("heading")).alias("_line"))
        there = hits.where("phrase IS NULL").unionByName(hits.where("phrase IS NOT NULL").join(lines, "doc_id").where(F.col("_line").contains(F.col("phrase"))).select(*hits.columns))
    met = there.select("query_id", "pred", "doc_id").distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("_met"))
    return met.join(small(requests.select("query_id", _predicates().alias("_asks"))), "query_id").where("_met = _asks").select("query_id", "doc_id")


def _predicates() -> Column:
    """How many predicates a request has, dates aside; a party without words is met by all documents and is none."""
    named = [F.col(c).isNotNull().cast("int") for c in ("court", "bench", "section", "act", "judge")]
    party = F.coalesce(F.size(T.tokens(F.col("party"))) > 0, F.lit(False)).cast("int")
    total = party
    for n in named:
        total = total + n
    return total


def _by_dates(index: DataFrame, requests: DataFrame, most: int | None) -> DataFrame:
    """query_id, doc_id of requests that only their dates restrict: documents meet them by month. Without a bound all documents do, of which the first ``most`` are enough if it is given."""
    dated = index.select(F.col("id").alias("doc_id"), F.col("formatteddocumentdate").alias("_date"))
    ends = dated.agg(F.min("_date").alias("_from"), F.max("_date").alias("_to"))
    month = lambda d: F.trunc(d, "month")
    bounded = requests.where("date_from IS NOT NULL OR date_to IS NOT NULL").join(F.broadcast(ends), F.lit(True))
    first, last = F.greatest("date_from", "_from"), F.least("date_to", "_to")
    months = bounded.where(first <= last).select("query_id", "date_from", "date_to", F.explode(F.sequence(month(first), month(last), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    inside = dated.withColumn("_month", month(F.col("_date"))).join(small(months), "_month").where(between_dates(F.col("_date"), F.col("date_from"), F.col("date_to"))).select("query_id", "doc_id")
    unbound = requests.where("date_from IS NULL AND date_to IS NULL").select("query_id")
    if most is None:
        return inside.unionByName(dated.select("doc_id").crossJoin(small(unbound)).select("query_id", "doc_id"))
    least = dated.orderBy("doc_id").limit(most).agg(F.sort_array(F.collect_list("doc_id")).alias("_ids"))
    return inside.unionByName(unbound.join(F.broadcast(least), F.lit(True)).select("query_id", F.explode("_ids").alias("doc_id")))


def allowlists(index: DataFrame, requests: DataFrame, most: int | None = MOST, written: Index | None = None) -> DataFrame:
    """query_id, doc_id for a batch of requests (query_id and any columns of REQUEST), the first ``most`` of each (all if it is None); a request without a filter has no row.

    Strict matches, and for the queries that have none but ask for a filter with a looser form, loose ones. Requests meet documents by the terms that
    they look for, which ``written``, the index of the fields, has at hand; a document must be met by each predicate. A value without words
    is in no heading and no text; a party without words restricts nothing.
    """
    for name in REQUEST:
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("date" if name.startswith("date") else "string"))
    requests = kept(requests.where(F.coalesce(*(F.col(c).cast("string") for c in REQUEST)).isNotNull()).select("query_id", *REQUEST))
    some = requests.where(_predicates() > 0)
    dates = index.select(F.col("id").alias("doc_id"), F.col("formatteddocumentdate").alias("_date"))

    def matched(asked: DataFrame, loose: bool) -> DataFrame:
        found = _matched(index, asked, loose, written)
        if asked.where("date_from IS NOT NULL OR date_to IS NOT NULL").isEmpty():
            return found
        bounds = small(asked.select("query_id", "date_from", "date_to"))
        return found.join(bounds, "query_id").join(dates, "doc_id").where(between_dates(F.col("_date"), F.col("date_from"), F.col("date_to"))).select("query_id", "doc_id")

    strict = kept(matched(some, False))
    again = some.where(F.coalesce(*FALLBACK).isNotNull()).join(strict.select("query_id").distinct(), "query_id", "left_anti")
    every = strict if again.isEmpty() else strict.unionByName(matched(kept(again), True))
    rest = requests.where(_predicates() == 0)
    if not rest.isEmpty():
        every = every.unionByName(_by_dates(index, rest, most))
    return every if most is None else top(every, ["query_id"], [F.col("doc_id")], most).select("query_id", "doc_id")


def modes_of(read: DataFrame, allowed: DataFrame) -> DataFrame:
    """query_id, mode for queries with ``filters`` and ``dates`` and their allowlists."""
    asks = F.map_concat("filters", F.transform_keys("dates", lambda k, v: F.concat(F.lit("date "), k)))
    hits = allowed.groupBy("query_id").agg(F.count("*").alias("_hits"))
    return read.select("query_id", asks.alias("_asks")).join(hits, "query_id", "left").select("query_id", allowlist_mode(F.col("_asks"), F.coalesce("_hits", F.lit(0))).alias("mode"))


def allowlist_mode(filters: Column, hits: Column) -> Column:
    """none (no filters), empty_ignored (filters that match nothing restrict nothing) or applied."""
    return F.when(filters.isNull() | (F.size(filters) == 0), "none").when(hits == 0, "empty_ignored").otherwise("applied")


def within(hits: DataFrame, allowed: DataFrame, modes: DataFrame) -> DataFrame:
    """hits of queries whose allowlist applies, semi-joined with it, and all hits of the other queries."""
    applied = modes.where("mode = 'applied'").select("query_id")
    inside = hits.join(small(applied), "query_id", "left_semi").join(allowed, ["query_id", "doc_id"], "left_semi")
    return inside.unionByName(hits.join(small(applied), "query_id", "left_anti"))


def sanitised(query: Column, filters: Column) -> Column:
    """Map of the known filters whose value is not blank and stands in the query, whatever the case; dates are ``sanitised_dates``."""
    q = F.lower(query)
    return F.map_filter(filters, lambda k, v: k.isin(*(x for x in KEYS if x != "date_range")) & v.isNotNull() & (F.trim(v) != "") & q.contains(F.lower(v)))


def read_dates(filters: Column) -> Column:
    """Map of the bounds of a ``date_range`` that stands as JSON among the filters; null where it is no object."""
    return F.from_json(F.try_element_at(filters, F.lit("date_range")), "map<string,string>")


def sanitised_dates(query: Column, dates: Column) -> Column:
    """Map of the bounds gte and lte that are ISO dates with a year that stands in the query."""
    return F.map_filter(dates, lambda k, v: k.isin("gte", "lte") & v.isNotNull() & v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & query.contains(F.substring(v, 1, 4)))
