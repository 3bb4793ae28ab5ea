"""Context packing under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_pack(items: DataFrame, budget: int) -> DataFrame:
    """Items (key, position, tokens) up to the first that doesn't fit; a running sum per key."""
    w = Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)


def greedy_pack(items: DataFrame, budget: int) -> DataFrame:
    """(key, position, tokens, used): items in order, each that doesn't fit what is left is skipped. A fold over each key's own list."""
    rows = items.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "tokens"))).alias("items"))

    def step(s, x):
        fits = s["used"] + x["tokens"] <= budget
        used = F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"])
        taken = F.when(fits, F.concat(s["taken"], F.array(F.struct(x["position"].alias("position"), x["tokens"].alias("tokens"), used.alias("used"))))).otherwise(s["taken"])
        return F.struct(used.alias("used"), taken.alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<position:bigint,tokens:bigint,used:bigint>>)").alias("taken"))
    return rows.select("key", F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x")).select("key", "x.position", "x.tokens", "x.used")


def mget(ids: DataFrame, notes: DataFrame) -> DataFrame:
    """Wanted ids (position, id) in order, with what is found."""
    return ids.join(notes, "id", "left").orderBy("position")
