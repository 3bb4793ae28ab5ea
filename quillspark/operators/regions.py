"""Generated regions of notes: what stands between two marker lines, filled from templates, with a checksum of what was filled in.

Markers are read line by line within the row, so a collection's regions are found, checked and filled without moving texts;
only the keys of regions are joined with templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

PREFIX = "GENERATED"
_CHECKSUM = r"\A<!-- checksum:([a-f0-9]+) -->\r?\z"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def markers(lines: Column, kind: str, prefix: str = PREFIX) -> Column:
    """(at, key) of the START or END lines, at from 0. A START line must be ended; an END line may go on."""
    pattern = rf"\A<!-- {prefix}:([a-z0-9_]+):{kind} -->" + (r"\r?\z" if kind == "START" else "")
    each = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.regexp_extract(line, pattern, 1).alias("key")))
    return F.filter(each, lambda m: (m["key"] != "") & ((m["at"] < F.size(lines) - 1) if kind == "START" else F.lit(True)))


def regions(lines: Column, prefix: str = PREFIX) -> Column:
    """(key, at, end, checksum, content) of each START line with the first END line of its key that leaves a line between them.

    end is null where there is none. content excludes the checksum line, and checksum is empty without one."""

    def whole(ends: Column) -> Column:
        def one(m: Column) -> Column:
            end = F.get(F.filter(ends, lambda e: (e["key"] == m["key"]) & (e["at"] > m["at"] + 1)), 0)["at"]

            def filled(e: Column) -> Column:
                checksum = F.regexp_extract(F.get(lines, m["at"] + 1), _CHECKSUM, 1)
                first = m["at"] + F.when(checksum == "", 1).otherwise(2)
                kept = F.slice(lines, first + 1, F.greatest(F.coalesce(e, first) - first, F.lit(0)))
                content = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")
                return F.struct(m["key"].alias("key"), m["at"].alias("at"), e.alias("end"), checksum.alias("checksum"), content.alias("content"))

            return let(end, filled)

        return F.transform(markers(lines, "START", prefix), one)

    return let(markers(lines, "END", prefix), whole)


def region_issues(text: Column, prefix: str = PREFIX) -> Column:
    """(key, rule, line) of what is wrong with a text's markers, lines from 1; null texts give null.

    A key with one kind of marker only is malformed, told at its last one. With such keys nothing else is told. If all keys
    have both kinds but a START none after it, one issue without key and line says so; else keys met again are duplicates."""
    issue = lambda key, rule, at: F.struct(key.cast("string").alias("key"), F.lit(rule).alias("rule"), (at + 1).cast("int").alias("line"))

    def told(lines: Column) -> Column:
        starts, ends = markers(lines, "START", prefix), markers(lines, "END", prefix)
        keys = lambda ms: F.array_distinct(F.transform(ms, lambda m: m["key"]))
        last = lambda ms, k: F.array_max(F.transform(F.filter(ms, lambda m: m["key"] == k), lambda m: m["at"]))
        alone = lambda a, b: F.transform(F.array_except(keys(a), keys(b)), lambda k: issue(k, "malformed_markers", last(a, k)))
        open_ = F.exists(regions(lines, prefix), lambda r: r["end"].isNull())
        again = F.filter(starts, lambda m: F.exists(starts, lambda o: (o["key"] == m["key"]) & (o["at"] < m["at"])))
        rest = F.when(open_, F.array(issue(F.lit(None), "malformed_markers", F.lit(None).cast("int")))).otherwise(F.transform(again, lambda m: issue(m["key"], "duplicate_markers", m["at"])))
        return let(F.concat(alone(starts, ends), alone(ends, starts)), lambda one_sided: F.when(F.size(one_sided) > 0, one_sided).otherwise(rest))

    return let(lines_of(text), told)


def replaced(text: Column, key: Column, body: Column, force: bool = False, prefix: str = PREFIX) -> Column:
    """(text, error): the first region of that key with another body and its checksum, the rest as it was.

    Errors leave the text as it is: malformed_markers, marker_not_found, and checksum_mismatch for a body edited by hand since,
    which force overrides. A body is put in as it is; one without a line feed at its end runs into the END line."""

    def put(lines: Column) -> Column:
        def one(every: Column) -> Column:
            r = F.get(F.filter(every, lambda x: x["key"] == key), 0)
            ends = F.transform(markers(lines, "END", prefix), lambda m: m["key"])
            orphan = F.size(F.array_except(ends, F.transform(every, lambda x: x["key"]))) > 0
            error = (
                F.when(F.exists(every, lambda x: x["end"].isNull()) | orphan, "malformed_markers")
                .when(r.isNull(), "marker_not_found")
                .when(F.lit(not force) & (r["checksum"] != "") & (F.sha2(r["content"], 256) != r["checksum"]), "checksum_mismatch")
            )
            before, after = F.slice(lines, 1, r["at"] + 1), F.slice(lines, r["end"] + 1, F.size(lines))
            new = F.concat(F.array_join(before, "\n"), F.lit("\n<!-- checksum:"), F.sha2(body, 256), F.lit(" -->\n"), body, F.array_join(after, "\n"))
            return let(error, lambda e: F.struct(F.when(e.isNull(), new).otherwise(text).alias("text"), e.alias("error")))

        return let(regions(lines, prefix), one)

    return let(lines_of(text), put)


def rendered(notes: DataFrame, templates: DataFrame, force: bool = False, prefix: str = PREFIX) -> DataFrame:
    """(path, text, sections, error) of notes (path, type, text) with markers, all their regions filled from templates (type, section, body).

    sections counts the keys. A note with an error keeps its text: a region without a template (template_not_found), or an error of
    replaced(). Notes without markers have no row. Paths and (type, section) are unique. Only keys and templates are joined:
    a template's rows are met by (type, section), and a note's are as many as its keys."""
    marked = notes.filter(F.col("text").contains(f"<!-- {prefix}:"))
    keyed = marked.select("path", "type", F.posexplode(F.array_distinct(F.transform(regions(lines_of(F.col("text")), prefix), lambda r: r["key"]))).alias("at", "section"))
    met = keyed.join(templates.select("type", "section", "body", F.lit(True).alias("found")), ["type", "section"], "left")
    filled = met.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "section", "body", "found"))).alias("given"))
    lacks = F.exists("given", lambda g: g["found"].isNull())
    start = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, g: Column) -> Column:
        return F.when(acc["error"].isNotNull(), acc).otherwise(replaced(acc["text"], g["section"], F.coalesce(g["body"], F.lit("")), force, prefix))

    done = F.when(lacks, F.struct(F.col("text").alias("text"), F.lit("template_not_found").alias("error"))).otherwise(F.aggregate("given", start, step))
    rows = marked.join(filled, "path").select("path", "text", F.size("given").alias("sections"), done.alias("done"))
    return rows.select("path", F.when(F.col("done.error").isNull(), F.col("done.text")).otherwise(F.col("text")).alias("text"), "sections", "done.error")
