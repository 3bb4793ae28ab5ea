"""Collections of Markdown notes with YAML frontmatter."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links as L

#: The closing --- stands on a line of its own.
FRONT = r"(?s)\A---\r?\n(.*?)(?<=\n)---(?=[\r\n]|\z)(?:\r\n)?\n?"
# The canonical order of keys.
CORE = ("id", "type", "status", "title", "aliases", "tags", "created", "updated")


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, content, hash) of every .md file below root; exclude: names of folders or files, or prefixes of relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^[a-z0-9]+:/*|/+$", "", root).lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), rf"^/*\Q{base}\E/+", "")
    rows = files.select(rel.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash"))
    for x in exclude:
        rows = rows.filter(~(F.array_contains(F.split("path", "/"), x) | F.col("path").startswith(x.rstrip("/") + "/") | (F.col("path") == x)))
    return rows


def split_frontmatter(content: Column) -> tuple[Column, Column]:
    front = F.regexp_extract(content, FRONT, 1)
    return front, F.regexp_replace(content, FRONT, "")


def parse_yaml(front: str) -> dict[str, list[str]]:
    """Top-level keys of flat frontmatter with their values as lists: scalars, [a, b] and indented "- a" lists."""
    out: dict[str, list[str]] = {}
    key = None
    plain = lambda x: x.strip().strip("\"'")
    for line in front.splitlines():
        if m := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line):
            key, value = m.groups()
            value = value.strip()
            out[key] = [plain(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else [plain(value)] if value else []
        elif key and (m := re.match(r"\s*-\s+(.*)$", line)):
            out[key].append(plain(m[1]))
    return out


def notes(files: DataFrame) -> DataFrame:
    """Files as notes: id, path, type, title, status, created, updated, aliases, tags, extra, body_text, is_domain, hash, mtime.

    A note without both id and type is unstructured and gets an id from its path.
    """
    front, body = split_frontmatter(F.col("content"))

    def run(batches):
        for b in batches:
            maps = [list(parse_yaml(x or "").items()) for x in b["front"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps, pa.map_(pa.string(), pa.list_(pa.string())))], names=[*b.schema.names, "fm"])

    rows = files.select("path", "mtime", "hash", front.alias("front"), body.alias("body")).mapInArrow(run, "path string, mtime long, hash string, front string, body string, fm map<string,array<string>>")
    one = lambda k: F.nullif(F.get(F.col("fm")[k], 0), F.lit(""))
    domain = one("id").isNotNull() & one("type").isNotNull()
    many = lambda k: F.coalesce(F.col("fm")[k], F.array().cast("array<string>"))
    extra = F.map_filter("fm", lambda k, _: ~k.isin(*CORE))
    return rows.select(F.when(domain, one("id")).otherwise(F.concat(F.lit("_path:"), "path")).alias("id"), "path", *[one(k).alias(k) for k in ("type", "title", "status", "created", "updated")], many("aliases").alias("aliases"), many("tags").alias("tags"), extra.alias("extra"), T.strip_markdown(F.col("body")).alias("body_text"), "body", domain.alias("is_domain"), "hash", "mtime")


def links(notes_: DataFrame) -> DataFrame:
    """(src, raw, edge_type, target_kind, heading, block, confidence, origin) of the body's links and of relation fields.

    Of several with the same src, raw and edge_type the first is taken: by line and place, after those of fields."""
    body = L.extract(notes_.select("id", "body"))
    one = body.select("src", F.col("target").alias("raw"), "edge_type", "target_kind", "heading", "block", F.concat(F.lit("body:line:"), "line").alias("origin"), "n")
    field = lambda k: F.transform(F.coalesce(F.col("extra")[k], F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), F.lit(f"frontmatter.{k}").alias("origin")))
    given = notes_.select(F.col("id").alias("src"), F.explode(F.concat(*map(field, ("parent_id", "related_ids", "source_ids")))).alias("x"))
    two = given.select("src", "x.raw", F.lit("explicit_relation").alias("edge_type"), *[F.lit("").alias(c) for c in ("target_kind", "heading", "block")], "x.origin", F.lit(0).alias("n"))
    rest = F.struct("n", "origin", "target_kind", "heading", "block")
    first = one.unionByName(two).filter("raw <> ''").groupBy("src", "raw", "edge_type").agg(F.min(rest).alias("x"))
    return first.select("src", "raw", "edge_type", "x.target_kind", "x.heading", "x.block", F.lit("high").alias("confidence"), "x.origin")


def changes(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, change) between files and an index's (path, hash, mtime): added, changed, touched (same content) or deleted."""
    both = files.select("path", F.col("hash").alias("h"), F.col("mtime").alias("m")).join(catalog.select("path", F.col("hash").alias("ch"), F.col("mtime").alias("cm")), "path", "full_outer")
    return both.select("path", F.when(F.col("ch").isNull(), "added").when(F.col("h").isNull(), "deleted").when(F.col("m") == F.col("cm"), None).when(F.col("h") == F.col("ch"), "touched").otherwise("changed").alias("change")).filter("change is not null")
