"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document starts at the rate 1. Among the rates that make each source take its target
of words, the ones of least relative entropy under the bound ``most`` are
min(most, exp(l * size / mean)) with one multiplier l per source. The dual of that problem is convex
and separable; its gradient is the difference of the words taken and the target. Documents
are first counted by (source, size), which loses nothing, as the rate depends on no more;
each Newton iteration is one aggregation over these counts, with sums in decimals, which
do not depend on the order of rows. Iterations are on the logarithm of the words taken and stay in
a bracket, which a step that would leave it halves.

Rates become copies by carrying the remainder from larger sizes to smaller ones within a
source; the copies of a (source, size) cell go one each to the documents in the order of a
salted hash, so that no window holds more than about ``chunk`` rows of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, few_rows, named

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, size) cell that a window may hold.
CHUNK = 1024
#: Relative distance from the target at which Newton's method stops, and its largest number of steps.
CLOSE, STEPS = 1e-9, 60


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null and the empty string stay apart."""
    return F.when(source.isNull(), F.lit("~null")).otherwise(F.concat(F.lit("s:"), source.cast("string")))


def water_fill(sources: DataFrame, total: float, most: float = 2.0) -> DataFrame:
    """Append ``target``: ``total`` words shared by ``weight``, at most ``most`` times ``size``, the excess reshared.

    sources: key, size, weight; one row per source. Each round caps the sources that are above
    and reads three sums; it ends when none is above, or when all are capped.
    """
    held = sources.withColumn("capped", F.lit(False))
    while True:
        row = held.agg(
            F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w"),
            F.sum(F.when(F.col("capped"), F.col("size").cast("decimal(38,0)"))).alias("full"),
        ).first()
        level = max(0.0, total - most * float(row.full or 0)) / float(row.w) if row.w else 0.0
        above = ~F.col("capped") & (F.col("weight") * F.lit(level) > F.col("size") * F.lit(most))
        if not row.w or not held.where(above).limit(1).count():
            return held.withColumn("target", F.when(F.col("capped"), F.col("size") * F.lit(float(most))).otherwise(F.col("weight") * F.lit(level)).cast("double")).drop("capped")
        held = held.withColumn("capped", F.col("capped") | above)


def multipliers(cells: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """Append ``lam`` to targets (key, size, target): the dual optimum of each source.

    cells: key, size, n. A source without words has the multiplier 0; a target of 0 has minus
    infinity, and one of ``most`` times the size or more has plus infinity.
    """
    mean = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean"))
    state = targets.join(mean, "key", "left").select(
        "key",
        "size",
        "target",
        F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= most * F.col("size"), F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("lam"),
        F.lit(-1e9).alias("low"),
        F.lit(1e9).alias("high"),
        ((F.col("size") == 0) | (F.col("target") <= 0) | (F.col("target") >= most * F.col("size"))).alias("done"),
    )
    state = checkpoint(state)
    for _ in range(STEPS):
        if not state.where("NOT done").limit(1).count():
            break
        x = F.col("c") / F.col("mean")
        free = F.least(F.lit(float(most)), F.exp(F.col("lam") * x))
        words = F.col("cn") * F.col("c") * free
        sums = (
            cells.select("key", F.col("size").alias("c"), F.col("n").alias("cn"))
            .join(state.where("NOT done").select("key", "mean", "lam"), "key")
            .groupBy("key")
            .agg(F.sum(words.cast("decimal(38,9)")).cast("double").alias("took"), F.sum(F.when(free < most, words * x).otherwise(0.0).cast("decimal(38,9)")).cast("double").alias("slope"))
        )
        gap = F.log("took") - F.log("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap * F.col("took") / F.col("slope")
        bounded = F.when((F.col("high") < 1e9) & (F.col("low") > -1e9), (F.col("low") + F.col("high")) / 2).otherwise(F.col("lam") * 2 - F.signum(gap))
        step = F.when((F.col("slope") > 0) & (F.col("took") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(bounded)
        state = (
            state.join(sums, "key", "left")
            .withColumn("low", F.when(F.col("done"), F.col("low")).otherwise(low))
            .withColumn("high", F.when(F.col("done"), F.col("high")).otherwise(high))
            .withColumn("close", F.col("done") | (F.abs(gap) < CLOSE) | (F.col("high") - F.col("low") < 1e-12))
            .withColumn("lam", F.when(F.col("close"), F.col("lam")).otherwise(step))
            .select("key", "size", "target", "mean", "lam", "low", "high", F.col("close").alias("done"))
        )
        state = checkpoint(state)
    return state.select("key", "size", "target", "mean", "lam")


def rates(cells: DataFrame, duals: DataFrame, most: float = 2.0) -> DataFrame:
    """key, size, n, rate: the tilted rate of the documents of each cell."""
    joined = cells.join(duals.select("key", "mean", "lam"), "key")
    rate = F.when(F.col("lam") == float("inf"), F.lit(float(most))).when(F.col("lam") == float("-inf"), F.lit(0.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    return joined.select("key", "size", "n", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))


def rounded(cells: DataFrame, most: int = 2) -> DataFrame:
    """key, size, n, copies: whole copies of each cell; the words that rounding leaves go on to the next smaller size.

    One source's cells are folded in one row: an entry for each distinct size, not for each document.
    """
    cell = F.struct(F.col("size").alias("size"), F.col("n").alias("n"), F.col("rate").alias("rate"))
    empty = F.expr("cast(array() as array<struct<size:bigint,n:bigint,copies:bigint>>)")

    def take(state: Column, x: Column) -> Column:
        due = x["n"] * x["rate"] + F.when(x["size"] > 0, state["carry"] / x["size"]).otherwise(F.lit(0.0))
        copies = F.least(F.greatest(F.round(due), F.lit(0.0)), x["n"] * F.lit(float(most))).cast("long")
        rest = F.when(x["size"] > 0, (due - copies) * x["size"]).otherwise(state["carry"])
        return F.struct(rest.alias("carry"), F.concat(state["out"], F.array(F.struct(x["size"].alias("size"), x["n"].alias("n"), copies.alias("copies")))).alias("out"))

    # arrays are folded in runs of sizes, so that appending stays cheap for a source of many distinct sizes
    sorted_cells = F.sort_array(F.collect_list(cell), asc=False)
    folded = cells.groupBy("key").agg(sorted_cells.alias("cells"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / 64).cast("int")), lambda k: F.slice("cells", (k * 64 + 1).cast("int"), 64))

    def run(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["carry"].alias("carry"), empty.alias("out")), take)
        return F.struct(inner["carry"].alias("carry"), F.concat(state["outs"], F.array(inner["out"])).alias("outs"))

    nothing = F.expr("cast(array() as array<array<struct<size:bigint,n:bigint,copies:bigint>>>)")
    out = F.flatten(F.aggregate(runs, F.struct(F.lit(0.0).alias("carry"), nothing.alias("outs")), run)["outs"])
    return folded.select("key", F.explode(out).alias("c")).select("key", "c.*")


def mix(df: DataFrame, targets: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", most: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Append ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (copies times size) to the documents of df.

    targets: source, target (words). A source without a row there has the target 0. Null is a
    source like any other. Repeated rows are documents of their own; equal rows may swap their copies,
    which changes nothing. A document without words has the rate 1 and one copy. Reruns agree. Columns of df that are named like an
    appended one are replaced; names may hold dots.
    """
    p = "__m_"  # begins the names of the columns that are made on the way
    while any(c.lower().startswith(p) for c in df.columns):
        p = f"_{p}"
    hashed = F.xxhash64(named(key).cast("string"), F.lit("mix"))
    docs = df.select("*", source_key(named(source)).alias(f"{p}key"), F.coalesce(named(size).cast("long"), F.lit(0)).alias(f"{p}size"), hashed.alias(f"{p}h"))
    cells = checkpoint(docs.groupBy(F.col(f"{p}key").alias("key"), F.col(f"{p}size").alias("size")).agg(F.count("*").alias("n")))
    sizes = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    wanted = sizes.join(targets.select(source_key(named(source)).alias("key"), F.col("target").cast("double")), "key", "left").select("key", "size", F.coalesce("target", F.lit(0.0)).alias("target"))
    duals = multipliers(cells, wanted, most)
    plan = rates(cells, duals, most)
    copies = rounded(plan, most).join(plan.select("key", "size", "rate"), ["key", "size"]).join(duals.select("key", F.col("size").alias("source_size"), "target"), "key")
    copies = checkpoint(copies.withColumn("salts", F.ceil(F.col("n") / chunk).cast("long")))
    # only large cells are salted; at most n / chunk of them are told to the documents, by broadcast if they are few
    cell = [F.col("key").alias(f"{p}key"), F.col("size").alias(f"{p}size")]
    large = copies.where("salts > 1").select(*cell, F.col("salts").alias(f"{p}many"))
    docs = docs.join(few_rows(large), [f"{p}key", f"{p}size"], "left").withColumn(f"{p}salt", F.pmod(f"{p}h", F.coalesce(f"{p}many", F.lit(1))))
    spread = copies.select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias(f"{p}salt"), *(F.col(c).alias(f"{p}{c}") for c in ("n", "copies", "rate", "source_size", "target", "salts")))
    docs = docs.join(spread, [f"{p}key", f"{p}size", f"{p}salt"])
    # documents of a cell before a salt: a window over the salts of a cell, one row for each
    before = docs.where(f"`{p}salts` > 1").groupBy(f"{p}key", f"{p}size", f"{p}salt").agg(F.count("*").alias("m"))
    along = Window.partitionBy(f"{p}key", f"{p}size").orderBy(f"{p}salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(f"{p}key", f"{p}size", f"{p}salt", F.coalesce(F.sum("m").over(along), F.lit(0)).alias(f"{p}before"))
    place = F.row_number().over(Window.partitionBy(f"{p}key", f"{p}size", f"{p}salt").orderBy(f"{p}h", named(key)))
    docs = docs.withColumn(f"{p}place", place).join(before, [f"{p}key", f"{p}size", f"{p}salt"], "left")
    rank = F.col(f"{p}place") + F.coalesce(f"{p}before", F.lit(0))
    got = F.floor(F.col(f"{p}copies") / F.col(f"{p}n")) + F.when(rank <= F.pmod(f"{p}copies", f"{p}n"), 1).otherwise(0)
    got = F.when(F.col(f"{p}size") == 0, F.lit(1)).otherwise(got).cast("long")
    kept = [named(c) for c in df.columns if c not in ("source_size", "target", "rate", "copies", "taken")]
    return docs.withColumn(f"{p}got", got).select(*kept, F.col(f"{p}source_size").cast("long").alias("source_size"), F.col(f"{p}target").alias("target"), F.col(f"{p}rate").alias("rate"), F.col(f"{p}got").alias("copies"), (F.col(f"{p}got") * F.col(f"{p}size")).alias("taken"))
