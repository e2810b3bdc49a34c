"""Line dedup by the spread of a line over sites, with DataFrame functions only.

Each line (trimmed; blank ones never count) is known by two 64-bit hashes. One scan of the texts writes the hashes of each row's
lines; all that follows reads those. A HyperLogLog sketch of the sites is made for each line straight from its (line, site) rows: partial
sketches before the shuffle, merged after it, so a line that a third of all documents hold costs one sketch for each map task.
An estimate that is clearly under or over ``min_sites`` decides; only the rows of lines whose estimate is near are
made distinct and counted exactly. Texts with boilerplate lines are rewritten by a join on the text's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, few_rows, free_name, named, text_key

#: Sites from which a line is boilerplate, and the width of the sketches (2 ** LG_K registers).
MIN_SITES, LG_K = 10, 12
#: Relative distance from ``min_sites`` within which an estimate is checked exactly: six standard errors of a sketch.
NEAR = 6 * 1.04 / 2 ** (LG_K / 2)


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("b")).alias("b"))


def stripped(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _hashed(df: DataFrame, text: str, site: str) -> DataFrame:
    """t, site, keys: the text's key, the site's hash (null: no site) and the keys of the lines in order (null: a blank one), for each row with a text."""
    keys = F.transform(F.transform(F.split(named(text), "\n"), stripped), lambda x: F.when(x != "", line_key(x)))
    where = F.when(named(site).isNotNull(), F.xxhash64(named(site).cast("string")))
    return df.where(named(text).isNotNull()).select(text_key(named(text)).alias("t"), where.alias("site"), keys.alias("keys"))


def _spread(hashed: DataFrame, min_sites: int) -> DataFrame:
    pairs = hashed.where("site IS NOT NULL").select("site", F.explode("keys").alias("k")).where("k IS NOT NULL").select("k.a", "k.b", "site")
    sketches = pairs.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    estimates = checkpoint(sketches.where(F.col("estimate") >= min_sites * (1 - NEAR) - 1))
    near = estimates.where(F.col("estimate") <= min_sites * (1 + NEAR) + 1).select("a", "b")
    exact = pairs.join(few_rows(near), ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count("*").alias("exact"))
    return estimates.join(exact, ["a", "b"], "left").withColumn("sites", F.coalesce("exact", "estimate"))


def spread(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """a, b, estimate, exact, sites: every line near or over the threshold. A null site is no site; ``exact`` is null where the estimate decided."""
    return _spread(checkpoint(_hashed(df, text, site)), min_sites)


def without_boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, removed: str = "removed_lines") -> DataFrame:
    """df with ``text`` rewritten without the lines that stand on ``min_sites`` sites or more; ``removed_lines`` counts them.

    Every copy of such a line goes, on every site. A null text stays null, and a text of nothing but
    boilerplate becomes empty. Rows are kept one to one, repeated ones too, and all other columns as they are; a column that is named
    like ``removed`` is replaced. Names may hold dots.
    """
    hashed = checkpoint(_hashed(df, text, site))
    boilerplate = checkpoint(_spread(hashed, min_sites).where(F.col("sites") >= min_sites).select("a", "b"))
    key, hits = free_name(df, "text_key"), free_name(df, "hits")
    lines = hashed.select("t", F.posexplode("keys").alias("at", "k")).where("k IS NOT NULL").select("t", "at", "k.a", "k.b")
    found = lines.join(few_rows(boilerplate), ["a", "b"], "left_semi")
    # the places of a text's boilerplate lines: at most as many as the text has lines
    found = found.groupBy("t").agg(F.sort_array(F.collect_set("at")).alias(hits)).withColumnRenamed("t", key)
    found = checkpoint(found)  # with the aggregate out of the way, a text that many rows share can be split in the join
    joined = df.withColumn(key, text_key(named(text))).join(found, key, "left")
    new = F.when(F.col(hits).isNull(), named(text)).otherwise(F.array_join(_without(F.split(named(text), "\n"), F.col(hits)), "\n"))
    columns = [new.alias(c) if c == text else named(c) for c in df.columns if c != removed]
    return joined.select(*columns, F.coalesce(F.size(hits), F.lit(0)).cast("long").alias(removed))


def _without(parts: Column, places: Column) -> Column:
    """The parts but for those at the places (sorted, from 0): the stretches between them, so that the work is in proportion to the parts."""

    def between(s: Column) -> Column:
        stretch = lambda i: F.slice(s["parts"], s["ends"][i] + 2, s["ends"][i + 1] - s["ends"][i] - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["ends"]) - 2), stretch))

    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(parts)))
    return F.transform(F.array(F.struct(parts.alias("parts"), ends.alias("ends"))), between)[0]
