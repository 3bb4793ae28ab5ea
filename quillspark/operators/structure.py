"""Structure of Markdown bodies: headings, block ids, and full notes with what belongs to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify, without_space_around

# What marks fences, headings and block ids in a line.
FENCE, HEADING, BLOCK = r"^\s*(?:```|~~~)", r"^(#{1,6})\s+([^\n]+)\z", r"\^([a-zA-Z0-9][a-zA-Z0-9_-]*)\s*\z"
_MARK = "line int, kind string, level int, text string, heading string"


def marks(body: Column) -> Column:
    """Headings and block ids of a body outside code fences, with the heading that each block is under; null for a null body.

    Only lines with a mark are folded, so that the state that is carried along stays small.
    """
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    lines = F.filter(lines, lambda x: x["text"].rlike(f"{FENCE}|{HEADING}|{BLOCK}"))
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("heading"), F.from_json(F.lit("[]"), f"array<struct<{_MARK.replace(' ', ':').replace(',:', ',')}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fence, is_heading = x["text"].rlike(FENCE), x["text"].rlike(HEADING)
        title = without_space_around(F.regexp_extract(x["text"], HEADING, 2))
        heading = F.struct(x["line"].alias("line"), F.lit("heading").alias("kind"), F.length(F.regexp_extract(x["text"], HEADING, 1)).alias("level"), title.alias("text"), title.alias("heading"))
        block = F.struct(x["line"].alias("line"), F.lit("block").alias("kind"), F.lit(0).alias("level"), F.regexp_extract(x["text"], BLOCK, 1).alias("text"), s["heading"].alias("heading"))
        skip = fence | s["inside"]
        return F.struct(
            F.when(fence, ~s["inside"]).otherwise(s["inside"]).alias("inside"), F.when(~skip & is_heading, title).otherwise(s["heading"]).alias("heading"),
            F.when(skip, s["out"]).otherwise(F.concat(s["out"], F.array(F.when(is_heading, heading).otherwise(block)))).alias("out"),
        )

    return F.aggregate(lines, start, step, lambda s: s["out"])


def headings(notes: DataFrame) -> DataFrame:
    """(id, line, level, title, slug) of notes (id, body)."""
    each = notes.select("id", F.explode(marks(F.col("body"))).alias("m")).filter("m.kind = 'heading'")
    return each.select("id", "m.line", "m.level", F.col("m.text").alias("title"), slugify(F.col("m.text")).alias("slug"))


def blocks(notes: DataFrame) -> DataFrame:
    """(id, line, block_id, heading) of notes (id, body); heading: the last one before, empty if none."""
    each = notes.select("id", F.explode(marks(F.col("body"))).alias("m")).filter("m.kind = 'block'")
    return each.select("id", "m.line", F.col("m.text").alias("block_id"), "m.heading")


def full_notes(notes: DataFrame, **parts: DataFrame) -> DataFrame:
    """Notes with a column for each part (id, value): its distinct values in order, joined by the unit separator; null if none."""
    joined = [p.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("value")), chr(31)).alias(name)) for name, p in parts.items()]
    return reduce(lambda a, b: a.join(b, "id", "left"), joined, notes)


def with_alias(notes: DataFrame, aliases: DataFrame, alias: str, any_case: bool = False) -> DataFrame:
    """Notes (id) that have an alias (id, alias)."""
    key = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    return notes.join(aliases.filter(key(F.col("alias")) == key(F.lit(alias))).select("id").distinct(), "id", "left_semi")


def names(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (id, name) of titles (id, title) and aliases (id, alias), blank ones left out."""
    return titles.select("id", F.col("title").alias("name")).union(aliases.select("id", F.col("alias").alias("name"))).filter("trim(name) <> ''").distinct()


def links_with_titles(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links (src, dst) of known sources, with both ends' titles; an unknown target has none."""
    one, two = notes.select(F.col("id").alias("src"), F.col("title").alias("src_title")), notes.select(F.col("id").alias("dst"), F.col("title").alias("dst_title"))
    return links.join(one, "src").join(two, "dst", "left")


def links_both(links: DataFrame, of: str) -> DataFrame:
    """(id, direction) of a node's neighbours: out, in, or both."""
    out, into = links.filter(F.col("src") == of).select(F.col("dst").alias("id"), F.lit(1).alias("way")), links.filter(F.col("dst") == of).select(F.col("src").alias("id"), F.lit(2).alias("way"))
    return out.union(into).distinct().groupBy("id").agg(F.sum("way").alias("way")).select("id", F.element_at(F.array(F.lit("out"), F.lit("in"), F.lit("both")), F.col("way").cast("int")).alias("direction"))
