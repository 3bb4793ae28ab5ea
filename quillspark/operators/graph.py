"""Links, resolution, inference of edges and traversal. Edges are (src, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..shared import cut
from .traversal import traverse


def resolve(inputs: DataFrame, names: DataFrame, aliases: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """input -> (tier, id, n, ambiguous) of the first tier that matches. names: (id, title), aliases: (id, alias), paths: (id, path).

    Tiers: path, for inputs with a slash or that end in .md; id; title; alias; then, all called normalized, titles in any
    case, aliases in any case, and either with hyphens and underscores as spaces where that changes the input.
    Null inputs, names and aliases match nothing; repeated inputs are one.
    """
    given, i = inputs.select("input").distinct(), F.col("input")
    title = names.select(F.col("id").cast("string").alias("id"), F.col("title").alias("name"))
    none = title.limit(0)
    alias = none if aliases is None else aliases.select(F.col("id").cast("string").alias("id"), F.col("alias").alias("name"))
    path = none if paths is None else paths.select(F.col("id").cast("string").alias("id"), F.col("path").alias("name"))
    name = F.col("name")
    hyphens = normalise(i) != F.lower(i)
    tiers = [
        ("path", path, name, i, F.contains(i, F.lit("/")) | i.endswith(".md")), ("id", title, F.col("id"), i, None), ("title", title, name, i, None), ("alias", alias, name, i, None),
        ("normalized", title, F.lower(name), F.lower(i), None), ("normalized", alias, F.lower(name), F.lower(i), None), ("normalized", title.union(alias), normalise(name), normalise(i), hyphens),
    ]
    probes = []
    for k, (tier, table, key, wanted, only) in enumerate(tiers):
        asked = given if only is None else given.filter(only)
        probes.append(table.select(key.alias("key"), "id").join(F.broadcast(asked.select("input", wanted.alias("key"))), "key").select("input", F.lit(k).alias("tier_no"), F.lit(tier).alias("tier"), "id").distinct())
    found = reduce(DataFrame.union, probes)
    return found.withColumn("best", F.min("tier_no").over(Window.partitionBy("input"))).filter("tier_no = best").groupBy("input", "tier").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("ambiguous", F.col("n") > 1)


def links_out(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    """Targets of a node, known or not."""
    return edges.filter(F.col("src") == of).join(nodes, F.col("dst") == F.col("id"), "left").select("dst", "edge_type", F.col("id").isNotNull().alias("resolved"), "title")


def links_in(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("dst") == of).join(nodes, F.col("src") == F.col("id")).select("src", "edge_type", "title")


def neighbours(edges: DataFrame, start, depth: int, max_nodes: int | None = None, confidence: str | None = None) -> DataFrame:
    """(id, distance, parent, n) by breadth-first search from one node, edges (src, dst, ...) taken both ways; n: the place in order of discovery."""
    given = edges.columns
    filled = [F.col(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in (("edge_type", "string"), ("confidence", "string"), ("weight", "double"))]
    starts = edges.sparkSession.createDataFrame([(start,)], "start " + edges.schema["src"].dataType.simpleString())
    return traverse(edges.select("src", "dst", *filled), starts, depth, max_nodes, confidence).select("id", "distance", "parent", "n")


def tag_overlap(tags: DataFrame, threshold: float, n: int | None = None, digits: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """(a, b, weight, n_tags) of notes a < b whose common tags' ln(N / df) reach a sum. Tags (id, tag); null ids and tags link nothing, repeated ones are one.

    digits round the weights that are given. With of (id) every pair is given both ways, of those ways the ones that lead from a note of these.

    A tag is rare if its weight alone reaches the threshold. Only the others, of which there are at most e ** threshold times the tags of a
    note, are weighed before notes meet. They lie by weight, and a note is looked up by its rare tags and by those from which on its weights
    still reach the threshold: the heaviest common tag of two notes that belong together is among them on both sides.

    Notes go to their tags once, with 64 bits of all other tags, 16 bits of each other rare one, and the tags that aren't rare as they are.
    Two notes that share nothing of these share the met tag alone and are a result there, without a shuffle of pairs. The others bring a rare
    tag's weight from where they meet it, and the rest's from any of these places; these are summed, so equal bits of other tags add nothing.
    """
    tags = tags.select("id", "tag").filter("id is not null and tag is not null")
    total = F.lit(tags.agg(F.count_distinct("id")).first()[0] if n is None else n)
    weight = lambda count: F.log(total / count)
    # repeated tags only make a tag seem less rare, so that few are left to be counted without them
    often = cut(tags.groupBy("tag").count().filter(weight(F.col("count")) < threshold).select("tag"))
    common = cut(tags.join(often, "tag", "left_semi").distinct().groupBy("tag").count().select("tag", weight(F.col("count")).alias("w")).filter(F.col("w") < threshold))

    short, bit = (F.pmod(F.xxhash64("tag"), F.lit(1 << 16)) - (1 << 15)).cast("short"), lambda tag: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(tag), F.lit(64)).cast("int"))
    own = tags.repartition("id").join(common, "tag", "left")
    known = F.col("w").isNotNull()
    notes = own.groupBy("id").agg(
        F.collect_set(F.when(~known, F.struct("tag", short.alias("bits")))).alias("rare"),
        F.sort_array(F.collect_set(F.when(known, F.struct("w", "tag")))).alias("common"),
        F.bit_or(bit("tag")).alias("mask"),
    )
    notes = notes.withColumn("asked", F.lit(True)) if of is None else notes.join(of.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    reached = lambda s, x: s["sum"] + F.greatest(x["w"], F.lit(0.0))
    light = F.aggregate("common", start, lambda s, x: F.struct(reached(s, x).alias("sum"), (s["n"] + F.when(reached(s, x) < threshold - 1e-9, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    notes = notes.withColumns({"light": light, "n_rare": F.size("rare"), "n": F.size("rare") + F.size("common"), "tags": F.col("rare.tag"), "every": F.col("rare.bits")})
    met = notes.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).filter("i < n_rare or i >= n_rare + light")
    of_rare, i, n = F.col("i") < F.col("n_rare"), F.col("i"), F.col("n_rare")
    met = met.withColumn("x", F.when(~of_rare, F.get("common", i - n))).withColumn("tag", F.when(of_rare, F.get("tags", i)).otherwise(F.col("x.tag")))
    looked_up = met.select(
        "id",
        "asked",
        "tag",
        F.col("x.w").alias("w"),
        # the met tag's own bit goes, unless another tag has it too
        F.when(F.bit_count("mask") == F.col("n"), F.col("mask").bitwiseXOR(bit("tag"))).otherwise(F.col("mask")).alias("mask"),
        F.when(of_rare, F.concat(F.slice("every", F.lit(1), i), F.slice("every", i + 2, n))).otherwise(F.col("every")).alias("bits"),
        F.when(F.col("n") > n, F.col("common")).alias("common"),
    )

    # All pairs are made of the same columns, so that what notes bring along is shuffled once
    a, b = (lambda c: F.col("a." + c)), (lambda c: F.col("b." + c))
    alone = weight(F.count("*").over(Window.partitionBy("tag")))  # all notes of a rare tag are looked up by it
    one = looked_up.withColumn("alone", alone).withColumn("shown", F.col("alone") if digits is None else F.round("alone", digits))
    is_rare = F.greatest(a("w"), b("w")).isNull()
    shared_bits = a("mask").bitwiseAND(b("mask")) != 0
    other_rare = shared_bits & F.arrays_overlap(a("bits"), b("bits"))
    other_common = shared_bits & F.coalesce(F.array_size(a("common")) * F.array_size(b("common")) > 0, F.lit(False))
    pairs = lambda kept: one.alias("a").join(looked_up.alias("b"), (a("tag") == b("tag")) & F.when(a("id") < b("id"), (a("asked") | b("asked")) & kept))
    ends = a("id").alias("a"), b("id").alias("b"), a("asked").alias("from_a"), b("asked").alias("from_b")
    lone = pairs(is_rare & ~other_common & ~other_rare).select(*ends, a("shown").alias("weight"), F.lit(1).cast("long").alias("n_tags"))
    shared = F.when(other_common, F.array_intersect(a("common"), b("common")))
    several = pairs(other_common | other_rare).select(*ends, a("tag").alias("tag"), is_rare.alias("is_rare"), other_rare.alias("more"), a("alone").alias("alone"), F.explode(F.array(shared)).alias("shared"))
    rest = F.coalesce(F.aggregate("shared", F.lit(0.0), lambda s, x: s + x["w"]), F.lit(0.0))
    several = several.filter(F.col("is_rare") | (F.get("shared", F.size("shared") - 1)["tag"] == F.col("tag"))).withColumn("rest", rest)
    several = several.filter(F.col("is_rare") | F.col("more") | (F.col("rest") >= threshold))
    several = several.groupBy("a", "b", "from_a", "from_b").agg(
        (F.coalesce(F.sum(F.when(F.col("is_rare"), F.col("alone"))), F.lit(0.0)) + F.max("rest")).alias("weight"),
        (F.count(F.when(F.col("is_rare"), 1)) + F.max(F.coalesce(F.array_size("shared"), F.lit(0)))).alias("n_tags"),
    )
    several = several.filter(F.col("weight") >= threshold)
    several = several if digits is None else several.withColumn("weight", F.round("weight", digits))

    def ways(df: DataFrame) -> DataFrame:
        if of is None:
            return df.select("a", "b", "weight", "n_tags")
        there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        some = F.when(F.col("from_a") & F.col("from_b"), F.array(there, back)).when(F.col("from_a"), F.array(there)).otherwise(F.array(back))
        return df.select(F.explode(some).alias("x"), "weight", "n_tags").select("x.*", "weight", "n_tags")

    return ways(lone).union(ways(several))


def resolve_links(links: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """links (src, raw) with dst of the first pass (raw, dst) that knows the text, least dst in it."""
    out = links
    for i, p in enumerate(passes):
        out = out.join(p.groupBy("raw").agg(F.min("dst").alias(f"dst{i}")), "raw", "left")
    return out.select("src", "raw", F.coalesce(*[F.col(f"dst{i}") for i in range(len(passes))]).alias("dst")).withColumn("resolved", F.col("dst").isNotNull())
