"""Links between notes rewritten to the names of files, so that other programs that read the files can follow them.

Names are joined as rows, so no machine holds all of them; texts travel to the few names of their own links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

# A link without an anchor, with an optional text to show, and the frontmatter before a body.
LINK = r"\[\[([^\]|#]+)(\|([^\]]*))?\]\]"
FRONT = r"(?s)\A(---.*?\n---\n?)"


def stem(path: Column) -> Column:
    """The file's name without its folder and .md."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md\z", "")


def stems(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, stem) for every id, title and alias: ids count before titles, these before aliases; then the least id.

    notes: id, title, path. aliases: id, alias. Null and empty names are left out, and so are notes without a path."""
    file = stem(F.col("path"))
    known = notes.filter("path is not null").select(F.col("id").cast("string").alias("id"), "title", file.alias("stem"))
    of_alias = aliases.select(F.col("id").cast("string").alias("id"), "alias").join(known.select("id", "stem"), "id")
    names = [known.select(F.col("id").alias("name"), F.lit(0).alias("tier"), "id", "stem"), known.select(F.col("title").alias("name"), F.lit(1).alias("tier"), "id", "stem"), of_alias.select(F.col("alias").alias("name"), F.lit(2).alias("tier"), "id", "stem")]
    return reduce(DataFrame.unionByName, names).filter("name <> ''").groupBy("name").agg(F.min(F.struct("tier", "id", "stem"))["stem"].alias("stem"))


def _target(link: Column) -> Column:
    return F.regexp_extract(link, LINK, 1)


def fixed(files: DataFrame, notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, content, n_fixed, links) of every file whose links change; links: (old, new) in their order.

    files: path, content; paths are unique and null contents have no links. A link whose target is a known name other
    than its file's gets the file's name and shows what it showed before. Frontmatter and all else stay as they are.
    """
    files = cut(files.select("path", "content"))  # read for the links' targets, then for the bodies
    front = F.regexp_extract("content", FRONT, 1)
    split = files.select("path", front.alias("front"), F.substring(F.col("content"), F.length(front) + 1, F.length("content")).alias("body"))
    split = split.filter(F.contains("body", F.lit("[[")))
    targets = split.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(0)), _target))).alias("name"))
    known = targets.join(stems(notes, aliases).filter("name <> stem"), "name")
    own = known.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "stem"))).alias("new"))

    def renamed(link: Column) -> Column:
        to = F.try_element_at("new", _target(link))
        shown = F.when(F.regexp_extract(link, LINK, 2) != "", F.regexp_extract(link, LINK, 3)).otherwise(_target(link))
        return F.when(to.isNull(), link).otherwise(F.concat(F.lit("[["), to, F.lit("|"), shown, F.lit("]]")))

    both = split.join(own, "path").withColumn("old", F.regexp_extract_all("body", F.lit(LINK), F.lit(0))).withColumn("parts", F.split("body", LINK))
    both = both.withColumn("now", F.transform("old", renamed))
    body = F.concat(F.array_join(F.transform("now", lambda x, i: F.concat(F.get("parts", i), x)), ""), F.element_at("parts", -1))
    changed = F.filter(F.arrays_zip("old", "now"), lambda x: x["old"] != x["now"])
    rows = both.select("path", F.concat("front", body).alias("content"), F.transform(changed, lambda x: F.struct(x["old"].alias("old"), x["now"].alias("new"))).alias("links"))
    return rows.select("path", "content", F.size("links").alias("n_fixed"), "links").filter("n_fixed > 0")
