"""Validation and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(id, rule, severity) of every rule {name: (severity, broken)} that a row breaks, in one scan."""
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, broken) in rules.items()]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(found).alias("x")).select("id", "x.rule", "x.severity")


def broken_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References (id, ref) to nothing."""
    return refs.join(targets.select(F.col("target").alias("ref")), "ref", "left_anti").select("id", "ref")


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state) of (path, hash) on disk and in the index: unindexed, orphaned or drifted; agreement isn't listed."""
    both = disk.select("path", F.col("hash").alias("h1")).join(index.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    return both.withColumn("state", F.when(F.col("h2").isNull(), "unindexed").when(F.col("h1").isNull(), "orphaned").when(F.col("h1") != F.col("h2"), "drifted")).filter("state is not null").select("path", "state")


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("n > 1").select(key, order)


def coverage(notes: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """How many notes (id) have a row in each side (id), and in all."""
    out = reduce(lambda d, x: d.join(x[1].select("id").distinct().withColumn(x[0], F.lit(1)), "id", "left"), sides.items(), notes.select("id"))
    every = reduce(lambda a, b: a & b, (F.col(s).isNotNull() for s in sides))
    return out.agg(F.count("*").alias("n_notes"), *[F.count(s).alias(f"n_{s}") for s in sides], F.sum(every.cast("int")).alias("n_all"))


def registry_issues(notes: DataFrame, types: DataFrame, aliases: dict[str, list[str]] | None = None, core: tuple[str, ...] = ()) -> DataFrame:
    """(id, rule, severity, field) of notes (id, type, status, fields) against a registry of types (type, required, statuses), broadcast.

    An unknown type has no other issue. A required field counts under its own name or an alias of it, if it isn't blank; a status is
    held against its type's, where the type has any. Null and empty statuses aren't held against anything.
    """
    wide = types.select("type", F.array_union(F.array(*map(F.lit, core)).cast("array<string>"), "required").alias("required"), "statuses", F.lit(True).alias("known"))
    rows = notes.join(F.broadcast(wide), "type", "left")
    value = lambda name: F.coalesce(F.element_at("fields", name), F.lit(""))
    present = lambda name: ~value(name).isin("", '""')

    def missing(field: Column) -> Column:
        found = present(field)
        for canonical, others in (aliases or {}).items():
            for other in others:
                found = found | ((field == canonical) & present(F.lit(other)))
        return ~found & ~((field == "status") & (F.coalesce("status", F.lit("")) != ""))

    issue = lambda rule, severity, field: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), field.alias("field"))
    unknown = F.when(F.col("known").isNull(), F.array(issue("unknown_type", "warning", F.lit("type"))))
    lacking = F.transform(F.filter("required", missing), lambda f: issue("missing_required_field", "error", f))
    status = F.when((F.col("status") != "") & (F.size("statuses") > 0) & ~F.array_contains("statuses", F.col("status")), F.array(issue("invalid_status", "warning", F.lit("status")))).otherwise(F.array())
    return rows.select("id", F.explode(F.coalesce(unknown, F.concat(lacking, status))).alias("x")).select("id", "x.*")
