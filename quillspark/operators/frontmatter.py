"""Changes of frontmatter over a whole collection: plans of operations, checked, applied or refused as a whole, and normalisation.

A value keeps its YAML notation and an untouched key its lines, byte for byte. What a plan does to a key is an aggregate over the
plan's operations on it, so operations are never replayed one by one, and a key or plan with many rows is aggregated before it moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, snake_case

# Fields that never change, the canonical order of keys, keys of lists and of dates.
IMMUTABLE = ("id", "type")
ORDER = ("id", "type", "status", "title", "aliases", "tags", "created", "updated")
LISTS = ("aliases", "tags")
DATES = ("created", "updated", "due")
SET, UNSET, MERGE = "frontmatter_set", "frontmatter_unset", "frontmatter_merge"

_FRONT = r"(?s)\A---[^\n]*\n(.*?)(?<=\n)---(?=[\r\n]|\z)\r?\n?"
_NEXT = r"\n(?=[^\s#\-:][^\n:]*:(?:[ \t\n]|\z))"
_DATE = r"""\A["']?(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:Z|([+-])(\d\d):(\d\d))?)?["']?\z"""


def entries(content: Column) -> Column:
    """(key, lines) of a note's top-level keys in order, with the lines below each; null without frontmatter.

    Lines before the first key have the key ''. Keys lose their quotes."""
    front = F.regexp_replace(F.regexp_extract(content, _FRONT, 1), r"\r(?=\n)|\n\z", "")
    front = F.regexp_replace(front, r"\n\z", "")
    key = lambda e: F.regexp_extract(e, r"""\A["']?([^\s#\-:"'][^\n:"']*)["']?:(?:[ \t\n]|\z)""", 1)
    each = F.transform(F.filter(F.split(front, _NEXT), lambda e: e != ""), lambda e: F.struct(key(e).alias("key"), e.alias("lines")))
    return F.when(content.rlike(_FRONT), each)


def with_entries(content: Column, new: Column) -> Column:
    """The note with these entries as frontmatter: its own line ends, one blank line at most before the body, a line feed at the end as before."""
    head = F.regexp_extract(content, _FRONT, 0)
    body = F.substring(content, F.length(head) + 1, F.length(content))
    trimmed = F.regexp_replace(body, r"\A[\r\n]+", "")
    body = F.when((F.length(trimmed) < F.length(body)) & (trimmed != ""), F.concat(F.lit("\n"), trimmed)).otherwise(body)
    feed = F.when(content.rlike(r"\A[^\n]*\r\n"), "\r\n").otherwise("\n")
    front = F.replace(F.concat(F.lit("---\n"), F.array_join(F.transform(new, lambda e: e["lines"]), "\n"), F.lit("\n---\n")), F.lit("\n"), feed)

    def ended(out: Column) -> Column:
        had, has = content.endswith("\n"), out.endswith("\n")
        return F.when(had & ~has, F.concat(out, F.lit("\n"))).when(~had & has, F.left(out, F.length(out) - 1)).otherwise(out)

    return let(F.concat(front, body), ended)


def _value(e: Column) -> Column:
    """An entry's notation on its own line; null if it goes on below."""
    return F.when(~F.contains(e["lines"], F.lit("\n")), F.trim(F.regexp_extract(e["lines"], r"\A[^:]*:(.*)\z", 1)))


def _date(e: Column, strip_time: bool) -> Column:
    raw = _value(e)
    part = lambda i: F.regexp_extract(raw, _DATE, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int")
    at = F.try_make_timestamp_ntz(number(1), number(2), number(3), number(4), number(5), number(6).cast("decimal(8,6)"))
    east = F.when(part(7) == "-", -1).otherwise(1) * (number(8) * 60 + number(9))
    day = F.date_format(at - F.make_dt_interval(mins=east), "yyyy-MM-dd")
    midnight = (number(4) == 0) & (number(5) == 0) & (number(6) == 0)
    wanted = F.coalesce(raw.rlike(_DATE) & at.isNotNull() & (F.lit(strip_time) | midnight), F.lit(False))
    return F.when(wanted, F.concat(e["key"], F.lit(': "'), day, F.lit('"'))).otherwise(e["lines"])


def normalised(content: Column, strip_time: bool = False) -> Column:
    """The note with keys in canonical order, then by name; single aliases and tags as lists; dates at midnight, or all with strip_time,
    as quoted UTC days; camelCase keys in snake_case, after they are ordered. Null without frontmatter. A list key without a value stays so."""

    def one(e: Column) -> Column:
        raw = _value(e)
        single = F.coalesce(e["key"].isin(*LISTS) & (raw != "") & ~raw.rlike(r"\A[\[{|>]"), F.lit(False))
        lines = F.when(single, F.concat(e["key"], F.lit(":\n  - "), raw)).when(e["key"].isin(*DATES), _date(e, strip_time)).otherwise(e["lines"])
        name = snake_case(e["key"])
        renamed = F.when((name != e["key"]) & (e["key"] != ""), F.concat(name, F.regexp_replace(lines, r"\A[^:]*", ""))).otherwise(lines)
        return F.struct(name.alias("key"), renamed.alias("lines"))

    place = lambda e: F.when(e["key"] == "", -1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), e["key"]), F.lit(0)), F.lit(len(ORDER) + 1)))
    ordered = F.array_sort(F.transform(entries(content), lambda e, i: F.struct(place(e).alias("place"), e["key"].alias("key"), i.alias("i"), e["lines"].alias("lines"))))
    return with_entries(content, F.transform(ordered, one))


def checked(notes: DataFrame, operations: DataFrame, types: DataFrame, aliases: dict[str, list[str]] | None = None, core: tuple[str, ...] = ("id", "type", "status", "title", "aliases", "tags", "created", "updated")) -> DataFrame:
    """(plan, seq, op, path, key, status, error): what becomes of each operation (plan, seq, op, path, key, value) of each plan.

    notes: path, content. types: type, fields, required, statuses, a registry of which each type has one row. A merge is one row
    for each field under one seq, and the row with the least key that fails tells its error. A plan's first failing operation has the status error, later ones are
    skipped, earlier ones are ok but, as the plan is refused, have no effect. Errors, the first that holds: unknown_operation;
    missing_field; unresolved_target, no such path; parse_error, no frontmatter; not_domain_note, no id or type; immutable_field;
    unknown_key, neither a field of the type or of all types nor an alias of one; invalid_status; missing_required_field, for an unset
    after which neither the field nor an alias of it is on the note as it stood before the plan. Null plans and seqs are left out."""
    ops = operations.filter("plan is not null and seq is not null").select("plan", "seq", "op", "path", "key", "value")
    facts = notes.select("path", entries(F.col("content")).alias("e"), F.lit(True).alias("found"))  # texts end here
    plain = lambda k: F.regexp_replace(F.coalesce(_value(F.get(F.filter("e", lambda e: e["key"] == k), 0)), F.lit("")), r"""\A["']|["']\z""", "")
    facts = facts.select("path", "found", F.transform("e", lambda e: e["key"]).alias("keys"), plain("id").alias("id"), plain("type").alias("type"))
    rows = ops.join(facts, "path", "left").join(types.select("type", "fields", "required", "statuses"), "type", "left")
    none = F.array().cast("array<string>")
    known = F.array_union(F.array(*map(F.lit, core)), F.array_union(F.coalesce("fields", none), F.coalesce("required", none)))
    key, required = F.col("key"), F.coalesce("required", none)
    canonical, allowed, kept = key, F.array_contains(known, key), F.lit(False)
    for name, others in (aliases or {}).items():
        is_alias = key.isin(*others)
        allowed = allowed | (is_alias & F.array_contains(known, F.lit(name)))
        canonical = F.when(is_alias & ~F.array_contains(required, key) & F.array_contains(required, F.lit(name)), F.lit(name)).otherwise(canonical)
    for name, others in (aliases or {}).items():
        left = F.size(F.array_remove(F.array_intersect("keys", F.array(*map(F.lit, [name, *others]))), key)) > 0
        kept = kept | ((canonical == name) & left)
    writes = F.col("op").isin(SET, MERGE)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.regexp_replace("value", r"""\A["']|["']\z""", "")
    error = (
        F.when(~F.coalesce(F.col("op").isin(SET, UNSET, MERGE), F.lit(False)), "unknown_operation")
        .when(blank("path") | blank("key") | (writes & F.col("value").isNull()), "missing_field")
        .when(F.col("found").isNull(), "unresolved_target")
        .when(F.col("keys").isNull() | (F.size("keys") == 0), "parse_error")
        .when(blank("id") | blank("type"), "not_domain_note")
        .when(key.isin(*IMMUTABLE), "immutable_field")
        .when(writes & ~allowed, "unknown_key")
        .when(writes & (key == "status") & (F.size("statuses") > 0) & ~F.array_contains("statuses", status), "invalid_status")
        .when(~writes & F.array_contains(required, canonical) & ~kept, "missing_required_field")
    )
    told = rows.select("plan", "seq", "op", "path", "key", error.alias("error"))
    first = told.filter("error is not null").groupBy("plan").agg(F.min(F.struct("seq", "key", "error")).alias("first"))
    at, failed = F.col("first.seq"), F.col("first.seq").isNotNull()
    state = F.when(~failed | (F.col("seq") < at), "ok").when(F.col("seq") == at, "error").otherwise("skipped")
    return told.drop("error").join(first, "plan", "left").select("plan", "seq", "op", "path", "key", state.alias("status"), F.when(failed & (F.col("seq") == at), F.col("first.error")).alias("error"))


def applied(notes: DataFrame, operations: DataFrame, results: DataFrame) -> DataFrame:
    """(plan, path, before, content, changed) of every note that a plan without an error touches; results are those of checked().

    Each plan is applied to the notes as given; before is the SHA-256 of the note then, so that a write can refuse a note that has
    changed since. A key that is set keeps its place, one that is new, or was unset and set again, goes last, in the order of seq,
    then of key. Of operations on one key the last counts. A note's list has one row for each key that a plan names."""
    refused = results.filter("status = 'error'").select("plan").distinct()
    ops = operations.filter("plan is not null and seq is not null").join(refused, "plan", "left_anti").select("plan", "seq", "op", "path", "key", "value")
    by = ["plan", "path", "key"]
    gone = ops.filter(F.col("op") == UNSET).groupBy(by).agg(F.max("seq").alias("unset_at"))
    after = F.when((F.col("op") != UNSET) & (F.col("seq") > F.coalesce("unset_at", F.col("seq") - 1)), F.col("seq"))
    last = ops.join(gone, by, "left").groupBy(by).agg(F.max("unset_at").alias("unset_at"), F.min(after).alias("set_at"), F.max_by("value", F.struct(after.isNotNull(), "seq", "value")).alias("value"))
    listed = last.groupBy("plan", "path").agg(F.array_sort(F.collect_list(F.struct("set_at", "key", "unset_at", "value"))).alias("changes"))
    rows = notes.select("path", "content").join(listed, "path").withColumn("e", entries(F.col("content")))
    line = lambda c: F.struct(c["key"].alias("key"), F.concat(c["key"], F.lit(": "), c["value"]).alias("lines"))
    of = lambda e: F.get(F.filter("changes", lambda c: c["key"] == e["key"]), 0)
    stays = F.filter("e", lambda e: ~F.exists("changes", lambda c: (c["key"] == e["key"]) & c["unset_at"].isNotNull()))
    own = F.transform(stays, lambda e: F.coalesce(F.when(of(e).isNotNull(), line(of(e))), e))
    is_new = lambda c: c["set_at"].isNotNull() & (c["unset_at"].isNotNull() | ~F.exists("e", lambda e: e["key"] == c["key"]))
    new = F.transform(F.filter("changes", is_new), line)
    out = rows.select("plan", "path", "content", with_entries(F.col("content"), F.concat(own, new)).alias("new"))
    return out.select("plan", "path", F.sha2("content", 256).alias("before"), F.col("new").alias("content"), (F.col("new") != F.col("content")).alias("changed"))


def absent_keys(notes: DataFrame, operations: DataFrame) -> DataFrame:
    """(plan, seq, path, key) of operations that unset what isn't there: not on the note, or unset before in the plan."""
    keys = notes.select("path", F.explode(F.transform(entries(F.col("content")), lambda e: e["key"])).alias("key")).distinct()
    before = F.lag("op").over(Window.partitionBy("plan", "path", "key").orderBy("seq"))
    ops = operations.filter("plan is not null and seq is not null").withColumn("before", before).filter((F.col("op") == UNSET) & (F.col("before").isNull() | (F.col("before") == UNSET)))
    never = ops.filter("before is null").join(keys, ["path", "key"], "left_anti")
    columns = ("plan", "seq", "path", "key")
    return never.select(*columns).union(ops.filter("before is not null").select(*columns))
