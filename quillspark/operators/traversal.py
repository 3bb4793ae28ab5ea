"""Breadth-first search from many starts at once, with the order in which a queue would discover the nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import meets_confidence
from ..shared import cut

_PLACE = ("parent", "way", "id", "edge_type")


def _numbered(new: DataFrame, ranges: int) -> DataFrame:
    """new (start, parent, way, id, edge_type, ...) with `at`: its place from 0 among its start's, in that order.

    Rows are sorted in ranges, each of which is numbered for itself; a start's counts by range then give the offsets, so
    that a node with very many neighbours is numbered by many tasks."""
    ranged = cut(new.repartitionByRange(ranges, "start", *_PLACE).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("start", "range").agg(F.count("*").alias("m"))
    before = Window.partitionBy("start").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("start", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("start", "range").orderBy(*_PLACE)) - 1
    return ranged.withColumn("own", own).join(offsets, ["start", "range"]).withColumn("at", F.col("offset") + F.col("own")).drop("own", "offset", "range")


def traverse(edges: DataFrame, starts: DataFrame, depth: int, max_nodes: int | None = None, confidence: str | None = None) -> DataFrame:
    """(start, n, id, distance, parent, source, edge_type, confidence, weight): the nodes within depth of each start, numbered as discovered.

    edges: src, dst, edge_type, confidence, weight, taken both ways; those without a target or below the confidence aren't.
    starts: a column start. A node's neighbours come outgoing ones first, then by id and edge type; the first edge
    that reaches a node is given, with the node it was reached from as its parent, and the edge's own source. The start is node 0 of distance 0. At most max_nodes of each start are returned, the
    first discovered; a start that has so many isn't followed further. Repeated starts and edges count once.
    """
    kind, kept = edges.schema["src"].dataType.simpleString(), edges.filter("src is not null and dst is not null")
    if confidence is not None:
        kept = kept.filter(meets_confidence(F.col("confidence"), confidence))
    what = ("edge_type", "confidence", "weight")
    ways = [kept.select(F.col(a).alias("from"), F.lit(way).alias("way"), F.col(b).alias("id"), *what) for way, a, b in ((0, "src", "dst"), (1, "dst", "src"))]
    best = F.min(F.struct("way", "edge_type", "confidence", "weight")).alias("edge")
    # of several edges between two nodes only the first can discover anything
    near = cut(ways[0].unionByName(ways[1]).groupBy("from", "id").agg(best))
    first = starts.select(F.col("start").cast(kind).alias("start")).filter("start is not null").distinct()
    empty = [F.lit(None).cast(t) for t in (kind, kind, "string", "string", "double")]
    names = ("start", "n", "id", "distance", "parent", "source", *what)
    ranges = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = cut(first.select("start", F.lit(0).cast("long"), "start", F.lit(0), *empty).toDF(*names))
    levels, totals = [front], front.groupBy("start").agg(F.count("*").alias("total"))
    for d in range(1, depth + 1):
        if max_nodes is not None:
            front = front.join(totals.filter(F.col("total") < max_nodes).select("start"), "start", "left_semi")
        met = front.select("start", F.col("n").alias("parent"), F.col("id").alias("from")).join(near, "from")
        found = met.groupBy("start", "id").agg(F.min(F.struct("parent", "edge.way", "edge.edge_type", "edge.confidence", "edge.weight", "from")).alias("x"))
        seen = reduce(DataFrame.unionByName, [x.select("start", "id") for x in levels])
        new = found.join(seen, ["start", "id"], "left_anti").select("start", "id", "x.*")
        placed = _numbered(new, ranges).join(totals, "start").withColumn("n", F.col("total") + F.col("at"))
        if max_nodes is not None:
            placed = placed.filter(F.col("n") < max_nodes)
        source = F.when(F.col("way") == 0, F.col("from")).otherwise(F.col("id"))
        front = cut(placed.select("start", "n", "id", F.lit(d).alias("distance"), F.col("from").alias("parent"), source.alias("source"), *what))
        if front.isEmpty():
            break
        levels.append(front)
        totals = cut(reduce(DataFrame.unionByName, [x.select("start") for x in levels]).groupBy("start").agg(F.count("*").alias("total")))
    return reduce(DataFrame.unionByName, levels)
