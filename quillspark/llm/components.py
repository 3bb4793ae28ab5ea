"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is named by one of its nodes.

    Each round moves every node to the least of itself and its neighbours and contracts the links, which
    at least halves the nodes of every component; nothing but a flag reaches the driver.
    """
    edges, moves = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        one, two = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = cut(edges.join(one, "a").join(two, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        moves.append(to)
    for to in reversed(moves):
        labels = to.select("node", F.col("to").alias("component")) if labels is None else cut(to.join(labels.withColumnRenamed("node", "to"), "to", "left").select(to["node"], F.coalesce("component", "to").alias("component")))
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
