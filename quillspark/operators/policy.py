"""Whether changes may go ahead: a repository's state against rules, plans' shape, new notes, and where paths may lead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Decisions by severity, kinds of access, and what each rule decides for each kind; the rules that a commit can't be talked out of.
DECISIONS = ("allow", "warn", "refuse")
ACCESS = ("read", "dry_run", "write", "write_commit")
RULES = {
    "dirty_unrelated": ("allow", "allow", "warn", "warn"),
    "dirty_target": ("allow", "allow", "refuse", "refuse"),
    "detached_head": ("allow", "allow", "warn", "refuse"),
    "merge_in_progress": ("allow", "allow", "refuse", "refuse"),
    "no_repo": ("warn", "warn", "warn", "refuse"),
}
GUARDED = ("detached_head", "no_repo")
# Operations of a plan with the fields that each requires.
REQUIRED = {
    "frontmatter_set": ("target", "key", "value"),
    "frontmatter_unset": ("target", "key"),
    "frontmatter_merge": ("target", "fields"),
    "generated_region_render": ("target", "section_key", "template"),
    "note_create": ("path", "type", "frontmatter"),
}
VERSION, DEEPEST = 1, 4


def decided(requests: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """requests' rows with (decision, reasons): the severest decision of all rules that hold, and (rule, decision) of each.

    requests: access, target, and the state that the target's repository is in: repo, clean, detached, merging, rebasing (booleans),
    staged, unstaged (lists of paths). overrides replace what a rule decides for writes, but a commit stays refused by a guarded rule
    that has one. Unknown kinds of access are refused as invalid_operation; an empty target is neither dirty nor unrelated. Null
    states count as false, null lists as empty. Unknown rules or decisions in overrides are errors."""
    overrides = overrides or {}
    if bad := [f"{k}: {v}" for k, v in overrides.items() if k not in RULES or v not in DECISIONS]:
        raise ValueError(f"unknown rule or decision: {', '.join(bad)}")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = F.array().cast("array<string>")
    aimed = F.coalesce(F.col("target"), F.lit("")) != ""
    own = F.coalesce(F.array_contains(F.concat(F.coalesce("staged", none), F.coalesce("unstaged", none)), F.col("target")), F.lit(False))
    holds = {
        "dirty_unrelated": flag("repo") & ~flag("clean") & aimed & ~own,
        "dirty_target": flag("repo") & aimed & own,
        "detached_head": flag("repo") & flag("detached"),
        "merge_in_progress": flag("merging") | flag("rebasing"),
        "no_repo": ~flag("repo"),
    }

    def decision(rule: str) -> Column:
        each = list(RULES[rule])
        if rule in overrides:
            each[2], each[3] = overrides[rule], "refuse" if rule in GUARDED else overrides[rule]
        return reduce(lambda c, x: c.when(F.col("access") == x[0], x[1]), zip(ACCESS[1:], each[1:]), F.when(F.col("access") == ACCESS[0], each[0]))

    reason = lambda rule, d: F.struct(F.lit(rule).alias("rule"), d.alias("decision"))
    found = F.filter(F.array(*[F.when(holds[r], reason(r, decision(r))) for r in RULES]), lambda x: x.isNotNull())
    known = F.coalesce(F.col("access").isin(*ACCESS), F.lit(False))
    reasons = F.when(known, found).otherwise(F.array(reason("invalid_operation", F.lit("refuse"))))
    worst = reduce(lambda c, d: F.when(F.exists("reasons", lambda x: x["decision"] == d), d).otherwise(c), DECISIONS[1:], F.lit(DECISIONS[0]))
    return requests.withColumn("reasons", reasons).withColumn("decision", worst)


def plan_issues(plans: DataFrame, operations: DataFrame, types: DataFrame) -> DataFrame:
    """(plan, at, code, field) of what is wrong with the shape of plans (plan, version) and their operations, at their place `at`.

    operations: plan, at, op, target, key, value, fields, section_key, template, path, type, frontmatter; texts, of which an empty one is missing
    but for value and frontmatter, which are missing if null; fields is a map, and an empty one is missing. types: (type), unique, a registry
    that is sent to all tasks, as operations have few types and would meet in as few. A version other than 1 (unsupported_version) or a plan without operations (empty_plan) is told alone, without a place; null plans are left out."""
    supported = plans.filter("plan is not null").select("plan", (F.coalesce("version", F.lit(0)) == VERSION).alias("supported"))
    old = supported.filter("not supported").select("plan", F.lit(None).cast("int").alias("at"), F.lit("unsupported_version").alias("code"), F.lit(None).cast("string").alias("field"))
    good = supported.filter("supported").select("plan")
    empty = good.join(operations.select("plan").distinct(), "plan", "left_anti").select("plan", F.lit(None).cast("int").alias("at"), F.lit("empty_plan").alias("code"), F.lit(None).cast("string").alias("field"))
    rows = operations.join(F.broadcast(types.select("type", F.lit(True).alias("known"))), "type", "left")
    lacks = lambda f: F.col(f).isNull() if f in ("value", "frontmatter") else (F.coalesce(F.size("fields"), F.lit(0)) <= 0) if f == "fields" else (F.coalesce(F.col(f), F.lit("")) == "")
    issue = lambda code, field: F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"))
    told = [F.when((F.col("op") == op) & lacks(f), issue("missing_field", f)) for op, fields in REQUIRED.items() for f in fields]
    told += [F.when((F.col("op") == "note_create") & ~lacks("type") & F.col("known").isNull(), issue("unknown_type", "type"))]
    told += [F.when(~F.coalesce(F.col("op").isin(*REQUIRED), F.lit(False)), issue("unknown_operation", "op"))]
    faulty = rows.select("plan", "at", F.filter(F.array(*told), lambda x: x.isNotNull()).alias("issues")).filter("size(issues) > 0")  # alone of all fields they are shuffled
    found = faulty.join(good, "plan", "left_semi").select("plan", "at", F.explode("issues").alias("x")).select("plan", "at", "x.code", "x.field")
    return old.union(empty).union(found)


def created(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, at, id, content, error) of new notes (path, at, type, fields, body); existing: (path) of notes that are there.

    fields maps keys to values in YAML notation. The id is fields' own or type-name, name being the file's without .md. Keys are written by name, the body after an
    empty line with a line feed at its end. Errors: escapes, path_exists, also for a path that a request with a smaller `at` makes."""
    taken = existing.select("path", F.lit(True).alias("taken")).distinct()
    again = F.row_number().over(Window.partitionBy("path").orderBy("at")) > 1
    rows = requests.withColumn("again", again).join(taken, "path", "left")
    error = F.when(~confined(F.col("path")), "escapes").when(F.col("taken") | F.col("again"), "path_exists")
    given = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md\z", "")
    name = F.coalesce(F.nullif(F.try_element_at(given, F.lit("id")), F.lit("")), F.concat_ws("-", "type", stem))
    every = F.map_concat(F.map_filter(given, lambda k, _: ~k.isin("id", "type")), F.create_map(F.lit("id"), name, F.lit("type"), F.col("type")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(every)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n")
    body = F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), F.col("body"), F.when(F.col("body").endswith("\n"), "").otherwise("\n")))
    content = F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), body)
    return rows.select("path", "at", F.when(error.isNull(), name).alias("id"), F.when(error.isNull(), content).alias("content"), error.alias("error"))


def confined(path: Column) -> Column:
    """Whether a relative path stays inside its collection: not empty, not absolute, never above its top on the way."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce((path != "") & ~path.startswith("/") & (depth["least"] >= 0), F.lit(False))


def collections(files: DataFrame, marker: str, deepest: int = DEEPEST) -> DataFrame:
    """(root) of each folder that holds the marker (a file or folder), of files (path) below one top, itself ''.

    A folder more than `deepest` below the top isn't one, nor is one inside another: each path looks only at its own folders, and
    the outermost of them that is marked counts, so no folder is read twice."""
    parts = F.split("path", "/")
    marked = files.select(F.filter(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(deepest))), lambda i: F.get(parts, i) == marker).alias("at"), parts.alias("parts")).filter("size(at) > 0")
    roots = marked.select(F.array_join(F.slice("parts", 1, F.col("at")[0]), "/").alias("root")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("root", "/")) - 1), lambda i: F.array_join(F.slice(F.split("root", "/"), 1, i), "/"))
    inside = roots.filter("root <> ''").select("root", F.explode(above).alias("outer")).join(roots.withColumnRenamed("root", "outer"), "outer", "left_semi").select("root").distinct()
    return roots.join(inside, "root", "left_anti")
