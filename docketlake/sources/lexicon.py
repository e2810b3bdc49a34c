"""The lexicon: word classes, synonyms and normal forms, and how it is built from token rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries up to which a lexicon is held in expressions; a larger one is joined (``token_join``).
MOST_LITERALS = 20_000


@dataclass(frozen=True)
class Lexicon:
    """A small lexicon held by the driver; keys are upper case."""

    courts: set[str] = field(default_factory=set)
    journals: set[str] = field(default_factory=set)
    stopwords: set[str] = field(default_factory=set)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    normal: dict[str, str] = field(default_factory=dict)

    def synonym_map(self) -> Column:
        pairs = [x for k, v in sorted(self.synonyms.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")

    def normal_map(self) -> Column:
        pairs = [F.lit(x) for kv in sorted(self.normal.items()) for x in kv]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


#: A small lexicon of our own for examples and tests.
SAMPLE = Lexicon(
    courts={"HIGHCOURT", "AAR", "ITAT"},
    journals={"ITR", "SCC", "CTR"},
    stopwords={"ABLE", "OF", "IN", "CASE", "THE", "ON"},
    synonyms={"ACIT": ["ASSISTANT COMMISSIONER INCOME TAX"], "CIT": ["COMMISSIONER INCOME TAX", "COMMISSIONER OF INCOME TAX"], "DEPRECIATION": ["amortisation"]},
    normal={"115I": "115-I", "12A": "12-A"},
)


def build(rows: DataFrame) -> DataFrame:
    """kind, key, values of token rows (key, zone_type, search_text): one word class or list for each key.

    Courts and benches come first, then journals and stop words; countries go; a search text with bars is a list of
    synonyms, and any other that differs from the key is its normal form; the rest goes.
    """
    zone, text = F.coalesce("zone_type", F.lit("")), F.trim(F.coalesce("search_text", F.lit("")))
    kind = (
        F.when(zone.contains("COURT") | zone.contains("BENCH"), "court")
        .when(zone == "JOURNAL", "journal")
        .when(zone == "STOPWORD", "stopword")
        .when(zone.contains("COUNTRY"), None)
        .when(text.contains("|"), "synonym")
        .when((text != "") & (F.upper(text) != F.upper("key")), "normal")
    )
    parts = F.filter(F.transform(F.split(text, r"\|"), lambda t: F.trim(t)), lambda p: p != "")
    values = F.when(F.col("kind") == "synonym", parts).when(F.col("kind") == "normal", F.array(text)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "key", values.alias("values"))


def sizes(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("kind").agg(F.count("*").alias("n"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon written as JSON lines of kind, key, values."""
    return spark.read.schema("kind string, key string, values array<string>").json(path)


def held(lexicon: DataFrame) -> Lexicon:
    """The lexicon in the driver; refuses one of more than MOST_LITERALS entries."""
    rows = lexicon.limit(MOST_LITERALS + 1).collect()
    if len(rows) > MOST_LITERALS:
        raise ValueError(f"a lexicon of more than {MOST_LITERALS} entries is joined, not held")
    of = lambda kind: {r["key"].upper(): r["values"] for r in rows if r["kind"] == kind}
    return Lexicon(set(of("court")), set(of("journal")), set(of("stopword")), of("synonym"), {k: v[0] for k, v in of("normal").items()})


def token_join(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """Each token with its class, synonyms and normal form from a lexicon of any size, by a join on the upper-case token."""
    wide = lexicon.groupBy(F.upper("key").alias("_key")).agg(
        *(F.max(F.when(F.col("kind") == k, True)).alias(f"is_{k}") for k in ("court", "journal", "stopword")),
        F.first(F.when(F.col("kind") == "synonym", F.col("values")), ignorenulls=True).alias("synonyms"),
        F.first(F.when(F.col("kind") == "normal", F.col("values")[0]), ignorenulls=True).alias("normal"),
    )
    out = tokens.join(wide, F.upper(F.col(token)) == F.col("_key"), "left").drop("_key")
    for k in ("court", "journal", "stopword"):
        out = out.withColumn(f"is_{k}", F.coalesce(f"is_{k}", F.lit(False)))
    return out.withColumn("synonyms", F.coalesce("synonyms", F.array(token))).withColumn("normal", F.coalesce("normal", F.col(token)))
