"""Connected components of a link table, for links of which one node or one component may hold a large share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, few_rows

#: Rows of one key from which a join deals the key to several tasks.
HEAVY = 5_000


def heavy(df: DataFrame, key: str, most: int = HEAVY) -> DataFrame:
    """key, parts: the keys of df with more than ``most`` rows, and in how many parts they are dealt."""
    many = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return many.select(key, F.ceil(F.col("_n") / most).cast("int").alias("parts"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, parts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key) on ``key``; rows of a heavy key are dealt to its parts by ``by``."""
    own = left.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    each = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    spread = right.join(parts, key, "left").withColumn("_part", F.explode(each)).drop("parts")
    return own.join(spread, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, ids: DataFrame, rounds: int = 60, most: int = HEAVY) -> DataFrame:
    """node, root: the least (id, node) of each component; edges: a, b; ids: node, id. Nodes without an edge have no row.

    Each round a node takes the least label of its neighbours and then its label's label. Neither a node with very many
    links nor a component with very many nodes is joined in one task: such keys are counted and dealt to parts.
    """
    ends = edges.where("a <> b").select("a", "b")
    both = checkpoint(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = few_rows(checkpoint(heavy(both, "b", most)))
    state = checkpoint(both.select(F.col("a").alias("node")).distinct().join(ids, "node").select("node", F.struct("id", "node").alias("root")))
    for _ in range(rounds):
        near = dealt_join(both, state.select(F.col("node").alias("b"), "root"), "b", "a", hubs).groupBy("a").agg(F.min("root").alias("m"))
        low = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        low = checkpoint(low.withColumn("at", F.col("root.node")))
        jump = low.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = dealt_join(low, jump, "at", "node", few_rows(heavy(low, "at", most)), "left")
        new = checkpoint(new.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
