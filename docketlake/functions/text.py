"""Text analysis as Column functions: tokens, query shapes, merges, boost phrases, identifiers, rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.lexicon import Lexicon

# Patterns and word lists that decide results.
TOKEN = r"[\p{L}\p{N}]+"
SECTION = r"(?iU)\b(?:section|sec\.?|u/s|rule|article)\s*\d+[A-Za-z]*(?:\(\d+\))?"
CITATION = r"(?iU)\(?\d{4}\)?\s*\(?\d*\)?\s*[A-Z]{2,10}\s*\d+"
PARTY = r"(?iU)\bv(?:s\.?|ersus)?\.?\s+\w"
COURT_WORDS = ("court", "high", "tribunal")
LEGAL_MARKERS = (
    "bharatiya nyaya sanhita",
    "bharatiya nagarik suraksha sanhita",
    "bharatiya sakshya adhiniyam",
    "indian penal code",
    "income-tax act",
    "income tax act",
    "cgst act",
    "igst act",
    "customs act",
    "code of criminal procedure",
    "indian evidence act",
)
KNOWN_COURTS = (
    "Supreme Court",
    "Delhi High Court",
    "Bombay High Court",
    "Madras High Court",
    "Calcutta High Court",
    "Karnataka High Court",
    "Gujarat High Court",
    "Income Tax Appellate Tribunal",
    "Customs Excise and Service Tax Appellate Tribunal",
)
KNOWN_ACTS = (
    "Income-tax Act, 1961",
    "CGST Act",
    "IGST Act",
    "Customs Act, 1962",
    "Bharatiya Nyaya Sanhita",
    "Bharatiya Nagarik Suraksha Sanhita",
    "Bharatiya Sakshya Adhiniyam",
    "Indian Penal Code",
    "Code of Criminal Procedure",
    "Indian Evidence Act",
)
HIGHLIGHT_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "and", "or", "but", "if", "that",
    "this", "it", "its", "their", "they", "does", "do", "did", "can", "could", "from", "by", "as", "with", "not", "so",
)
OVERLAP_FLOOR = 0.6


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def citation_spacing(query: Column) -> Column:
    """A space between a four-digit year and a letter right after it."""
    return F.regexp_replace(query, "([0-9]{4})([a-zA-Z])", "$1 $2")


def query_shape(query: Column) -> Column:
    """citation, provision or plain; a citation or a party wins over a section."""
    q = citation_spacing(query)
    return F.when(q.rlike(CITATION) | q.rlike(PARTY), "citation").when(q.rlike(SECTION), "provision").otherwise("plain")


def _string_array() -> Column:
    return F.array().cast("array<string>")


def merge_keyword_number(parts: Column) -> Column:
    """Any part and an all-digit part after it become one, from left to right; a merged number is used up."""

    def step(state: Column, part: Column) -> Column:
        open_ = state["open"].isNotNull()
        merge = open_ & part.rlike("^[0-9]+$")
        out = F.when(merge, F.concat(state["out"], F.array(F.concat_ws(" ", state["open"], part)))).when(open_, F.concat(state["out"], F.array(state["open"]))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.when(~merge, part).alias("open"))

    start = F.struct(_string_array().alias("out"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(parts, start, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def merge_court_city(parts: Column) -> Column:
    """A run of court words joins the part before it, whatever that is."""

    def step(state: Column, part: Column) -> Column:
        joins = state["open"].isNotNull() & F.lower(part).isin(*COURT_WORDS)
        out = F.when(joins | state["open"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(state["open"])))
        return F.struct(out.alias("out"), F.when(joins, F.concat_ws(" ", state["open"], part)).otherwise(part).alias("open"))

    start = F.struct(_string_array().alias("out"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(parts, start, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def _among(token: Column, names: set[str]) -> Column:
    return F.upper(token).isin(*sorted(names)) if names else F.lit(False)


def is_court(token: Column, lexicon: Lexicon) -> Column:
    return _among(token, lexicon.courts)


def is_journal(token: Column, lexicon: Lexicon) -> Column:
    return _among(token, lexicon.journals)


def is_stopword(token: Column, lexicon: Lexicon) -> Column:
    return _among(token, lexicon.stopwords)


def synonyms_of(token: Column, lexicon: Lexicon) -> Column:
    """The token's synonyms, or the token itself."""
    return F.coalesce(F.element_at(lexicon.synonym_map(), F.upper(token)), F.array(token))


def normalised(token: Column, lexicon: Lexicon) -> Column:
    return F.coalesce(F.element_at(lexicon.normal_map(), F.upper(token)), token)


def strip_stopwords(parts: Column, lexicon: Lexicon) -> Column:
    """Stop words go, but for journals."""
    return F.filter(parts, lambda t: is_journal(t, lexicon) | ~is_stopword(t, lexicon))


def expand_synonyms(query: Column, lexicon: Lexicon) -> Column:
    """The query followed by the synonyms of its words that are not in it yet, each once, whatever the case."""
    parts = words(query)
    found = F.flatten(F.transform(parts, lambda t: synonyms_of(t, lexicon)))

    def step(state: Column, s: Column) -> Column:
        new = ~F.array_contains(state["seen"], F.upper(s))
        return F.struct(F.when(new, F.concat(state["seen"], F.array(F.upper(s)))).otherwise(state["seen"]).alias("seen"), F.when(new, F.concat(state["extra"], F.array(s))).otherwise(state["extra"]).alias("extra"))

    start = F.struct(F.transform(parts, F.upper).alias("seen"), _string_array().alias("extra"))
    extra = F.aggregate(found, start, step, lambda s: s["extra"])
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def quoted_phrases(query: Column) -> Column:
    """Quoted phrases first, then the words that are left."""
    return F.concat(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), words(F.regexp_replace(query, '"([^"]+)"', " ")))


def boost_phrases(query: Column, lexicon: Lexicon) -> Column:
    """What is left of more than one word after quoting, merging and stop words."""
    return F.filter(strip_stopwords(merge_court_city(merge_keyword_number(quoted_phrases(query))), lexicon), lambda t: t.contains(" "))


def protected_identifiers(text: Column) -> Column:
    """Upper-cased tokens that are all upper case and two or longer, or hold an upper-case letter and a digit."""
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9][A-Za-z0-9()/-]*\b"), F.lit(0))
    upper = lambda t: t.rlike("[A-Z]")
    keep = F.filter(found, lambda t: (upper(t) & ~t.rlike("[a-z]") & (F.length(t) >= 2)) | (upper(t) & t.rlike("[0-9]")))
    return F.array_distinct(F.transform(keep, F.upper))


def _numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0))))


def _plain_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def token_overlap(query: Column, rewritten: Column) -> Column:
    """Share of the query's tokens that the rewrite keeps; null for a query without tokens."""
    q = _plain_tokens(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, _plain_tokens(rewritten))) / F.size(q))


def safe_rewrite(query: Column, rewritten: Column) -> Column:
    """The rewrite, or the query if the rewrite adds an act or a court, changes numbers, loses an identifier or keeps too few words."""
    q, r = F.lower(query), F.lower(rewritten)
    adds = F.lit(False)
    for name in (*LEGAL_MARKERS, *(c.lower() for c in KNOWN_COURTS)):
        adds = adds | (r.contains(name) & ~q.contains(name))
    numbers = _numbers(query) != _numbers(rewritten)
    loses = F.size(F.array_except(protected_identifiers(query), protected_identifiers(rewritten))) > 0
    few = F.coalesce(token_overlap(query, rewritten) < OVERLAP_FLOOR, F.lit(False))
    return F.when(adds | numbers | loses | few, query).otherwise(rewritten)


def query_terms(query: Column) -> Column:
    """Distinct lower-case words of three characters or more that are not stop words, longest first, else in order."""
    found = F.array_distinct(F.filter(tokens(query), lambda w: (F.length(w) >= 3) & ~w.isin(*HIGHLIGHT_STOPWORDS)))
    placed = F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda s: s["w"])


def highlighted(text: Column, query: Column) -> Column:
    """Whole words of the query marked in the text, whatever the case."""
    terms = query_terms(query)
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(terms, "|"), F.lit(r")\b"))
    return F.when((F.size(terms) == 0) | (F.length(text) == 0), text).otherwise(F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, without blank parts."""
    return F.filter(F.split(text, "\n{2,}"), lambda p: F.trim(p) != "")


def bold_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\*\*.+?\*\*"), F.lit(0))


def clipped(text: Column, limit: int = 500, tail: str = "...") -> Column:
    """The text, or its first ``limit`` characters and the tail if it is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def preview(text: Column, limit: int = 200) -> Column:
    return F.substring(text, 1, limit)


def slug(text: Column) -> Column:
    """Runs of other characters than ASCII letters, digits, _ and - become one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")


def socket_url(url: Column) -> Column:
    """The http(s) address of a ws(s) one."""
    return F.regexp_replace(url, "^ws", "http")


def schema_context(collections: dict[str, str], fields: list[str]) -> str:
    """The text that tells a rewriting model what can be searched and filtered."""
    lines = [f"- {name}: {what}" for name, what in collections.items()]
    return "\n".join(["Collections searched together:", *lines, "Filters: " + ", ".join(fields), "Courts: " + ", ".join(KNOWN_COURTS), "Acts: " + ", ".join(KNOWN_ACTS), "Names outside these lists keep the user's wording."])
