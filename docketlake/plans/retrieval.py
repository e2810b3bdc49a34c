"""Retrieval over a batch of queries: dense and sparse lists per collection, their fusion, and full-text search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import value_factors
from ..operators import codes, filters, fuse, postings, rank, score
from ..operators.postings import Index
from ..sources import fixtures
from ..sources.lexicon import SAMPLE, Lexicon
from ..storage import kept, new_folder
from ..tables import table

LIMIT, TEXT_LIMIT = 50, 20
CHUNK_NAMES = postings.Names("collection", "chunk_id", "doc_id")


@dataclass(frozen=True)
class Corpus:
    """What is searched: the full-text index, the chunks, and the chunks that have a vector (``embedding``); and the written indexes of fields and chunks, if there are."""

    index: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    fields: Index | None = None
    words: Index | None = None


@dataclass(frozen=True)
class Allowed:
    """Allowlists of a batch (query_id, doc_id) and how they count (query_id, mode)."""

    documents: DataFrame
    modes: DataFrame

    def within(self, hits: DataFrame) -> DataFrame:
        return filters.within(hits, self.documents, self.modes)

    def only(self) -> tuple[DataFrame, DataFrame]:
        """(query_id of those whose allowlist applies; query_id, doc_id of theirs), for a search of the written index."""
        applied = self.modes.where("mode = 'applied'").select("query_id")
        return applied, self.documents.join(score.small(applied), "query_id", "left_semi").select("query_id", "doc_id")


def dense_hits(chunks: DataFrame, vectors: DataFrame, limit: int = LIMIT, allowed: Allowed | None = None) -> DataFrame:
    """query_id, collection, collection_ord, pos, chunk_id, doc_id, text, score: the top chunks of each collection, within the allowlists.

    All chunks are compared by their codes (``codes.coded``). Where an allowlist counts, its documents' chunks alone are, and exactly.
    """
    if allowed is None:
        scored = codes.best(chunks, vectors, limit)
    else:
        applied = score.small(allowed.modes.where("mode = 'applied'").select("query_id"))
        listed = allowed.documents.join(applied, "query_id", "left_semi").join(score.small(vectors.select("query_id", "vector")), "query_id")
        inside = chunks.drop(*codes.COLUMNS).join(listed, "doc_id").where(codes.usable(F.col("embedding")) & (F.size("embedding") == F.size("vector")))
        inside = inside.withColumn("score", F.round(score.dot(F.col("embedding"), F.col("vector")), 6)).drop("vector")
        scored = codes.best(chunks, vectors.join(applied, "query_id", "left_anti"), limit)
        scored = inside.select(*scored.columns).unionByName(scored)
    hits = rank.top(scored, ["query_id", "collection"], [F.col("score").desc(), F.col("chunk_id")], limit, "pos")
    return hits.select("query_id", "collection", "collection_ord", "pos", "chunk_id", "doc_id", "text", "score")


def _factor() -> Column:
    return value_factors(F.col("documenttypeboost"), F.col("court_boost"), F.col("landmarkruling"))


def write_fields(index: DataFrame) -> Index:
    """The written index of the full-text fields; documents are ordered by their value factors, and blacklisted ones have none."""
    static = index.where(score.allowed(F.col("landmarkruling"))).select(F.col("id").alias("doc_id"), _factor().alias("static"))
    return postings.write(score.fields_long(index), new_folder(index.sparkSession, "fields"), "field", "doc_id", static=static)


def write_words(chunks: DataFrame) -> Index:
    """The written index of the chunks' texts by collection; ``ruling`` has no sparse field."""
    return postings.write(chunks.where(F.col("collection") != "ruling"), new_folder(chunks.sparkSession, "words"), "collection", "chunk_id", carry="doc_id", positions=False)


def sparse_hits(chunks: DataFrame, queries: DataFrame, limit: int = LIMIT, allowed: Allowed | None = None, written: Index | None = None) -> DataFrame:
    """As dense_hits, by BM25 of the text; ``ruling`` has no sparse field. An allowlist does not change the statistics.

    ``written`` is the chunks' index; without it the chunks are scanned.
    """
    terms, only = score.query_terms(queries), allowed.only() if allowed else None
    if written is None:
        scored = postings.search_texts(chunks.where(F.col("collection") != "ruling"), terms, limit, CHUNK_NAMES, only=only)
    else:
        scored = postings.search(written, terms, limit, apart=True, only=only)
    best = rank.top(scored, ["query_id", "collection"], [F.col("score").desc(), F.col("chunk_id")], limit, "pos").drop("doc_id")
    # only the best chunks' texts are needed: their side is the small one
    best = score.few(best, queries, limit * len(fixtures.SPARSE))
    texts = chunks.where(F.col("collection") != "ruling")
    return texts.select("chunk_id", "collection", "doc_id", "text", "collection_ord").join(best, ["chunk_id", "collection"]).select("query_id", "collection", "collection_ord", "pos", "chunk_id", "doc_id", "text", "score")


def sparse_batches(chunks: DataFrame, batches: list[tuple[DataFrame, Allowed | None]], limit: int = LIMIT, written: Index | None = None) -> list[DataFrame]:
    """The sparse hits of several batches of queries, each within its own allowlists, by one search; they are written once."""
    tagged = lambda df, i: df.withColumn("query_id", F.concat(F.lit(f"{i} "), F.col("query_id").cast("string")))
    every, listed = None, None
    for i, (queries, allowed) in enumerate(batches):
        own = tagged(queries.select("query_id", "query"), i)
        every = own if every is None else every.unionByName(own)
        if allowed is not None:
            own = Allowed(tagged(allowed.documents, i), tagged(allowed.modes, i))
            listed = own if listed is None else Allowed(listed.documents.unionByName(own.documents), listed.modes.unionByName(own.modes))
    hits = kept(sparse_hits(chunks, every, limit, listed, written))
    parts = []
    for i, (queries, _) in enumerate(batches):
        plain = F.expr(f"substring(query_id, {len(str(i)) + 2})").cast(queries.schema["query_id"].dataType)
        parts.append(hits.where(F.col("query_id").startswith(f"{i} ")).withColumn("query_id", plain))
    return parts


def sparse_ranks(chunks: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query_id, collection, chunk_id, doc_id, score, pos, collection_ord: as sparse_hits of a single batch, for what needs no texts; no index is written, and no text is shuffled."""
    scored = postings.search_texts(chunks.where(F.col("collection") != "ruling"), score.query_terms(queries), limit, CHUNK_NAMES)
    return rank.top(scored, ["query_id", "collection"], [F.col("score").desc(), F.col("chunk_id")], limit, "pos").withColumn("collection_ord", fixtures.collection_order())


def _written(spark: SparkSession, sf_dir: str, name: str, write):
    """An index of the tables' documents, written once in a session and for each set of files."""
    context = spark.sparkContext
    if not hasattr(context, "_docketlake_indexes"):
        context._docketlake_indexes = {}
    key = (name, sf_dir, tuple(sorted(table(spark, sf_dir, "documents").inputFiles())))
    if key not in context._docketlake_indexes:
        context._docketlake_indexes[key] = write()
    return context._docketlake_indexes[key]


def fields_index(spark: SparkSession, sf_dir: str) -> Index:
    return _written(spark, sf_dir, "fields", lambda: write_fields(fixtures.index(spark, sf_dir)))


def coded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that have a vector, with their codes."""
    return _written(spark, sf_dir, "codes", lambda: codes.write(fixtures.hybrid_chunks(spark, sf_dir), new_folder(spark, "codes")))


def words_index(spark: SparkSession, sf_dir: str) -> Index:
    return _written(spark, sf_dir, "words", lambda: write_words(fixtures.chunks(spark, sf_dir)))


def corpus(spark: SparkSession, sf_dir: str, written: bool = True) -> Corpus:
    """The tables' documents; ``written`` is False for single batches, which need a scan and no index of fields or chunks."""
    return Corpus(fixtures.index(spark, sf_dir), fixtures.chunks(spark, sf_dir), coded_chunks(spark, sf_dir), fields_index(spark, sf_dir) if written else None, words_index(spark, sf_dir) if written else None)


class Remembered:
    """A search of queries (query_id, query) that looks for each distinct text once: its hits are kept, and a text that comes again, in this call or a later one, gets them."""

    def __init__(self, search: Callable[[DataFrame], DataFrame]):
        self.search, self.texts, self.hits = search, None, None

    def new(self, queries: DataFrame) -> DataFrame:
        """query: the distinct texts that were not asked before."""
        asked = queries.where("query IS NOT NULL").select("query").distinct()
        return kept(asked if self.texts is None else asked.join(self.texts, "query", "left_anti"))

    def __call__(self, queries: DataFrame) -> DataFrame:
        new = self.new(queries)
        if self.hits is None or not new.isEmpty():
            self.learn(new, kept(self.search(new.select(F.col("query").alias("query_id"), "query"))))
        return self.hits.join(score.small(queries.select("query_id", "query")), "query").select("query_id", *(c for c in self.hits.columns if c != "query"))

    def learn(self, texts: DataFrame, hits: DataFrame) -> None:
        """Take the kept hits (query_id, which is the text, and more) of distinct texts (query), none of which was asked before."""
        hits = hits.withColumnRenamed("query_id", "query")
        self.texts, self.hits = (texts, hits) if self.hits is None else (self.texts.unionByName(texts), self.hits.unionByName(hits))


class Searches:
    """The full-text and sparse searches that the steps of one run share; a run's texts are remembered as long as it is."""

    def __init__(self, corpus: Corpus, limit: int = LIMIT, text_limit: int = TEXT_LIMIT):
        self.full_text = Remembered(lambda queries: full_text(corpus.index, queries, limit=text_limit, written=corpus.fields))
        self.sparse = Remembered(lambda queries: sparse_hits(corpus.chunks, queries, limit, written=corpus.words))


def dense_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hits of all queries over the chunks that have a vector."""
    return dense_hits(coded_chunks(spark, sf_dir), fixtures.query_vectors(spark, sf_dir))


def sparse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse hits of all queries over all chunks."""
    return sparse_hits(fixtures.chunks(spark, sf_dir), fixtures.queries(spark, sf_dir), written=words_index(spark, sf_dir))


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return dense_lists(spark, sf_dir), sparse_lists(spark, sf_dir)


def as_sources(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Both in one table of flat lists: query_id, source, src_ord, pos, chunk_id, doc_id, text."""
    parts = [rank.flattened(h, ["query_id"]).select("query_id", F.lit(name).alias("source"), F.lit(i).alias("src_ord"), F.col("flat_pos").alias("pos"), "chunk_id", "doc_id", "text") for i, (name, h) in enumerate((("dense", dense), ("sparse", sparse)))]
    return parts[0].unionByName(parts[1])


def fused_chunks(dense: DataFrame, sparse: DataFrame, intents: DataFrame | None = None, weighting: bool = True) -> DataFrame:
    """Chunks by weighted reciprocal rank; intents: query_id, intent."""
    hits = as_sources(dense, sparse)
    weight = None
    if intents is not None:
        hits = hits.join(score.small(intents), "query_id", "left")
        weight = fuse.intent_weight(F.coalesce("intent", F.lit("unknown")), F.col("source"), weighting)
        hits = hits.withColumn("weight", weight).drop("intent")
        weight = F.col("weight")
    return fuse.fused_rank(fuse.reciprocal(hits, "chunk_id", weight))


def full_text(index: DataFrame, queries: DataFrame, lexicon: Lexicon = SAMPLE, limit: int = TEXT_LIMIT, loose: bool = False, written: Index | None = None) -> DataFrame:
    """query_id, pos, doc_id, score, heading, subheading: boosted fields and phrases, times value factors, without blacklisted documents.

    Shape and phrases come from the query as it was; its synonyms only widen the terms. ``loose``: terms allow edits. ``written`` is
    the fields' index; without it the documents are scanned, but for terms that allow edits, for which one is written.
    """
    q = F.col("query")
    prepared = queries.select("query_id", T.expand_synonyms(q, lexicon).alias("query"), T.query_shape(q).alias("shape"), T.boost_phrases(q, lexicon).alias("phrases"))
    phrases, boost = prepared.select("query_id", F.explode("phrases").alias("phrase")), score.boost(F.col("shape"), F.col("field"))
    if written is None and not loose:
        docs = index.select(F.col("id").alias("doc_id"), F.when(score.allowed(F.col("landmarkruling")), _factor()).alias("static"), score.field_texts().alias("texts"))
        scored = postings.search_documents(docs, shaped_terms(None, prepared), phrases, limit, postings.Names("field", "doc_id"), boost)
    else:
        written = written or write_fields(index)
        bonus = postings.phrase_scores(written, phrases)
        scored = postings.search(written, shaped_terms(written, prepared, loose), limit, boost=boost, bonus=bonus, factors=True)
    best = score.few(rank.top(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id")], limit, "pos"), queries, limit)
    shown = index.select(F.col("id").alias("doc_id"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("subheading", F.lit("")).alias("subheading"))
    return shown.join(best, "doc_id").select("query_id", "pos", "doc_id", "score", "heading", "subheading")


def shaped_terms(written: Index | None, queries: DataFrame, loose: bool = False) -> DataFrame:
    """query_id, term, shape (and word, with ``loose``) of queries (query_id, query, shape)."""
    terms = score.query_terms(queries).join(score.small(queries.select("query_id", "shape")), "query_id")
    return postings.widened(written, terms) if loose else terms


def fields_search(written: Index, queries: DataFrame, limit: int, loose: bool = False) -> DataFrame:
    """query_id, doc_id, score: among them the best by boosted fields alone; queries: query_id, query, shape."""
    return postings.search(written, shaped_terms(written, queries, loose), limit, boost=score.boost(F.col("shape"), F.col("field")))
