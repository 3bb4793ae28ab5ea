"""Context packs: a target's text and its neighbours' under a token budget, for many targets at once.

Notes are (id, frontmatter, body, updated), frontmatter as JSON; edges are (src, dst, edge_type, confidence, at), `at` their order.
A null or empty body has no text to pack. Ids are unique in notes; repeated edges are one candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, estimate_tokens, excerpt, excerpt_sizes
from ..functions.vectors import edge_priority

UNBOUNDED = 1 << 40


def targets(notes: DataFrame, budget: int, excerpt_tokens: int = 0) -> DataFrame:
    """(target, fm_tokens, body, body_tokens, truncated, remaining): frontmatter first, then an excerpt or as much of the body as is left."""
    rows = notes.select(F.col("id").alias("target"), estimate_tokens(F.col("frontmatter")).alias("fm_tokens"), F.coalesce("body", F.lit("")).alias("text"))
    left = F.lit(budget) - F.col("fm_tokens")
    whole = estimate_tokens(F.col("text"))
    rows = rows.withColumn("part", excerpt("text", F.greatest(F.least(F.lit(excerpt_tokens), left), F.lit(0)), excerpt_tokens) if excerpt_tokens > 0 else F.lit(""))
    cut = F.when((left > 0) & (F.octet_length("text") > left * 4), cut_bytes(F.col("text"), left * 4)).when(left > 0, F.col("text")).otherwise("")
    rows = rows.withColumn("body", F.when(F.col("part") != "", F.col("part")).otherwise(cut))
    used = F.when(F.col("part") != "", estimate_tokens(F.col("part"))).when(left > 0, F.least(whole, left)).otherwise(0)
    truncated = (left <= 0) | (F.col("text") == "") | (whole > left)
    return rows.select("target", "fm_tokens", "body", used.alias("body_tokens"), truncated.alias("truncated"), (left - used).alias("remaining"))


def direct_candidates(edges: DataFrame) -> DataFrame:
    """(target, id, edge_type, confidence, priority, seen) of every note's neighbours; the first edge counts, those out before those in."""
    one = edges.select(F.col("src").alias("target"), F.col("dst").alias("id"), "edge_type", "confidence", F.struct(F.lit(0).alias("way"), "at").alias("seen"))
    two = edges.select(F.col("dst").alias("target"), F.col("src").alias("id"), "edge_type", "confidence", F.struct(F.lit(1).alias("way"), "at").alias("seen"))
    first = one.union(two).filter("target <> id").groupBy("target", "id").agg(F.min(F.struct("seen", "edge_type", "confidence")).alias("x"))
    return first.select("target", "id", "x.edge_type", "x.confidence", edge_priority(F.col("x.edge_type"), F.col("x.confidence")).alias("priority"), "x.seen")


def traversed_candidates(reached: DataFrame, edges: DataFrame, start) -> DataFrame:
    """The same of one start's traversal (id, distance, parent): ten a step, plus the priority of the first edge to the parent."""
    near = direct_candidates(edges).select("target", "id", "edge_type", "confidence", "priority", "seen")
    rows = reached.filter("distance > 0").join(near, (F.col("parent") == F.col("target")) & (reached["id"] == near["id"]))
    return rows.select(F.lit(start).alias("target"), reached["id"], "edge_type", "confidence", (F.col("distance") * 10 + F.col("priority")).alias("priority"), "seen")


def _ranked(candidates: DataFrame, notes: DataFrame, most: int, activation: DataFrame | None) -> DataFrame:
    """The first `most` candidates of each target that are notes, with their place. The rank's limit is taken before the shuffle."""
    facts = notes.select("id", "updated", estimate_tokens(F.col("frontmatter")).alias("fm_tokens"))
    rows = candidates.join(facts, "id")
    rows = rows.withColumn("activation", F.lit(0.0)) if activation is None else rows.join(activation.select("id", "activation"), "id", "left").fillna(0.0, ["activation"])
    w = Window.partitionBy("target").orderBy("priority", F.desc("activation"), F.desc("updated"), "seen", "id")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


def _with_bodies(rows: DataFrame, notes: DataFrame, excerpt_tokens: int) -> DataFrame:
    """Rows with the token counts that a body may take, the best first; texts stay behind."""
    text = F.coalesce("body", F.lit(""))
    sizes = excerpt_sizes("body", excerpt_tokens) if excerpt_tokens > 0 else F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(estimate_tokens(text)))
    return rows.join(notes.select("id", sizes.alias("sizes")), "id")


def _filled(rows: DataFrame, cap: int) -> DataFrame:
    """rows (target, left, position, cost, sizes, ...): each list in order; an item whose cost doesn't fit ends it, a body that doesn't fit is left out."""
    lists = rows.groupBy("target").agg(F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("position", "id", "edge_type", "confidence", "fm_tokens", "cost", "sizes"))).alias("items"))

    def step(s, x):
        fits = ~s["full"] & (x["cost"] <= s["left"])
        left = s["left"] - x["cost"]
        allowed = F.least(left, F.lit(cap))
        body = F.get(F.filter(x["sizes"], lambda n: n <= allowed), F.lit(0))
        item = F.struct(x["position"].alias("position"), x["id"].alias("id"), x["edge_type"].alias("edge_type"), x["confidence"].alias("confidence"), x["fm_tokens"].alias("fm_tokens"), body.alias("body_tokens"), allowed.alias("allowed"))
        return F.struct(F.when(fits, left - F.coalesce(body, F.lit(0))).otherwise(s["left"]).alias("left"), (~fits).alias("full"), F.when(fits, F.concat(s["taken"], F.array(item))).otherwise(s["taken"]).alias("taken"))

    kind = lists.select(F.transform("items", lambda x: F.struct(x["position"].alias("position"), x["id"].alias("id"), x["edge_type"].alias("edge_type"), x["confidence"].alias("confidence"), x["fm_tokens"].alias("fm_tokens"), F.get(x["sizes"], F.lit(0)).alias("body_tokens"), F.lit(0).cast("bigint").alias("allowed"))).alias("t")).schema["t"].dataType
    start = F.struct(F.col("left").cast("bigint").alias("left"), F.lit(False).alias("full"), F.array().cast(kind).alias("taken"))
    return lists.select("target", F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x")).select("target", "x.*")


def two_pass(packed: DataFrame, candidates: DataFrame, notes: DataFrame, budget: int, excerpt_tokens: int = 0, activation: DataFrame | None = None) -> DataFrame:
    """(target, position, id, edge_type, confidence, fm_tokens, body_tokens, allowed) of targets(): frontmatter up to the first that doesn't fit, then bodies in the same order.

    No target keeps more items than the budget has tokens, since each takes one at least; body_tokens is null without a body.
    """
    rows = _ranked(candidates, notes, budget, activation).join(packed.filter("remaining > 0").select("target", "remaining"), "target")
    w = Window.partitionBy("target").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("used", F.sum("fm_tokens").over(w)).filter("used <= remaining")
    kept = kept.withColumn("left", F.col("remaining") - F.max("used").over(Window.partitionBy("target"))).withColumn("cost", F.lit(0).cast("bigint"))
    return _filled(_with_bodies(kept, notes, excerpt_tokens), excerpt_tokens or UNBOUNDED)


def body_first(packed: DataFrame, candidates: DataFrame, notes: DataFrame, max_items: int, excerpt_tokens: int = 0, activation: DataFrame | None = None) -> DataFrame:
    """The same with each item's frontmatter and body at once, max_items at most."""
    rows = _ranked(candidates, notes, max_items, activation).join(packed.filter("remaining > 0").select("target", F.col("remaining").alias("left")), "target").withColumn("cost", F.col("fm_tokens"))
    return _filled(_with_bodies(rows, notes, excerpt_tokens), excerpt_tokens or UNBOUNDED)


def bodies(items: DataFrame, notes: DataFrame, excerpt_tokens: int = 0) -> DataFrame:
    """Packed items with their texts; null where the pack has none."""
    rows = items.join(notes.select("id", F.col("body").alias("text")), "id")
    text = excerpt("text", F.col("allowed"), excerpt_tokens) if excerpt_tokens > 0 else F.col("text")
    return rows.withColumn("body", F.when(F.col("body_tokens").isNotNull(), text)).drop("text")
