"""Incremental changes of a collection's tables, and comparison of a run with a stored one. Tables in, new tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of `changed` instead of its own of the same keys, for notes and for what belongs to them."""
    return table.join(changed.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(changed.select(*table.columns))


def replace_children(children: DataFrame, notes: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Children (tags, aliases, headings, links) with those of the notes (key) replaced by `new`; notes without new ones lose theirs."""
    return children.join(notes.select(key).distinct(), key, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def delete_notes(notes: DataFrame, links: DataFrame, gone: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """All tables without the notes `gone` (id): their children go, and links from them and to them."""
    ids = gone.select("id").distinct()
    left = {name: t.join(ids, "id", "left_anti") for name, t in {"notes": notes, **children}.items()}
    kept = links.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return {**left, "links": kept.select(*links.columns)}


def changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed, between path-to-hash tables; equal files give no row."""
    both = stored.select("path", F.col("hash").alias("old")).join(scanned.select("path", F.col("hash").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def run_means(results: DataFrame) -> DataFrame:
    """Mean hit and mean reciprocal rank of a run's queries (hit, rr); an empty run has 0 for both."""
    return results.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.count("*").alias("n"))


def regressions(snapshot: DataFrame, run: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(query, metric, was, now) of each metric of (query, metric, value) that fell by more than the tolerance; a missing one fell to null."""
    both = snapshot.select("query", "metric", F.col("value").alias("was")).join(run.select("query", "metric", F.col("value").alias("now")), ["query", "metric"], "left")
    return both.filter(F.col("now").isNull() | (F.col("was") - F.col("now") > tolerance))
