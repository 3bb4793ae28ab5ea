"""JSON lines of an event log with less or more left out, and one record that sums a collection up without its content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers, the version of records, and what of a result identifies a note.
OFF, ANONYMOUS, FULL, VERSION = "off", "anonymous", "full", 1
IDENTIFYING = ("note_id", "path")


def write_redacted(events: DataFrame, path: str, tier: str = "anonymous") -> None:
    """JSON lines of an event log: tier full as it is, pseudonymous with hashed users, anonymous also without payload."""
    if tier != "full":
        events = events.withColumn("user", F.sha2(F.col("user").cast("string"), 256))
    if tier == "anonymous":
        events = events.drop("props", "query_text", "event_data")
    events.write.mode("overwrite").json(path)


def _checked(tier: str) -> str:
    if tier == OFF:
        raise ValueError("the owner opted out of exports")
    if tier not in (ANONYMOUS, FULL):
        raise ValueError(f"tier {tier!r} is none of {OFF}, {ANONYMOUS}, {FULL}")
    return tier


def _map(v: Column) -> Column:
    return v.cast("map<string,variant>")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def redacted(data: Column, tier: str = ANONYMOUS) -> Column:
    """An event's payload, a JSON object, as a variant; null if it is no object.

    But for the full tier, the results in variants lose what identifies their notes. Parts of another shape than
    {variants: {name: {results: [{...}]}}} stay as they are."""
    parsed = F.try_parse_json(data)
    whole = F.when(_is(parsed, "OBJECT"), parsed)
    if _checked(tier) == FULL:
        return whole
    result = lambda r: F.when(_is(r, "OBJECT"), F.to_variant_object(F.map_filter(_map(r), lambda k, _: ~k.isin(*IDENTIFYING)))).otherwise(r)
    results = lambda v: F.when(_is(v, "ARRAY"), F.to_variant_object(F.transform(v.cast("array<variant>"), result))).otherwise(v)
    variant = lambda v: F.when(_is(v, "OBJECT"), F.to_variant_object(F.transform_values(_map(v), lambda k, x: F.when(k == "results", results(x)).otherwise(x)))).otherwise(v)
    variants = lambda v: F.when(_is(v, "OBJECT"), F.to_variant_object(F.transform_values(_map(v), lambda _, x: variant(x)))).otherwise(v)
    return F.when(whole.isNotNull(), F.to_variant_object(F.transform_values(_map(whole), lambda k, x: F.when(k == "variants", variants(x)).otherwise(x))))


def records(sessions: DataFrame, events: DataFrame, outcomes: DataFrame, tier: str, exported_at: str) -> DataFrame:
    """(part, at, value): an export's lines as JSON, a manifest (part 0), then sessions, events and outcomes with their times in `at`.

    sessions: session_id, started_at, ended_at, caller, caller_meta, user_session_id, root. events: event_id, session_id, event_type,
    timestamp, query_text, query_mode, primary_variant, event_data, root. outcomes: outcome_id, event_id, note_id, variant, rank,
    accessed_at, session_id. Times are texts. Null fields are left out, and but for the full tier so are roots, callers' details, questions
    and ids of notes. Tiers other than anonymous and full are errors. Order by part and at where order matters; nothing is sorted here."""
    _checked(tier)
    n = [t.agg(F.count("*").alias(k)) for t, k in ((sessions, "session_count"), (events, "event_count"), (outcomes, "outcome_count"))]
    counts = reduce(lambda a, b: a.crossJoin(b), n)  # one row each
    fields = [F.lit("manifest").alias("kind"), F.lit(tier).alias("tier"), F.lit(exported_at).alias("exported_at"), "session_count", "event_count", "outcome_count", F.lit(VERSION).alias("schema_version")]
    line = lambda part, at, *c: (F.lit(part).alias("part"), at.alias("at"), F.to_json(F.struct(*c)).alias("value"))
    more = lambda *c: c if tier == FULL else ()
    parts = [
        counts.select(*line(0, F.lit(None).cast("string"), *fields)),
        sessions.select(*line(1, F.col("started_at"), F.lit("session").alias("kind"), "session_id", "started_at", "ended_at", "caller", "user_session_id", *more("root", "caller_meta"))),
        events.withColumn("data", redacted(F.col("event_data"), tier)).select(*line(2, F.col("timestamp"), F.lit("event").alias("kind"), "event_id", "session_id", "event_type", "timestamp", "query_mode", "primary_variant", *more("root", "query_text"), "data")),
        outcomes.select(*line(3, F.col("accessed_at"), F.lit("outcome").alias("kind"), "outcome_id", "event_id", "variant", "rank", "accessed_at", "session_id", *more("note_id"))),
    ]
    return reduce(DataFrame.union, parts)


def write_records(lines: DataFrame, path: str) -> None:
    """An export as text files whose names' order is the order of part and at, with the manifest first."""
    lines.orderBy("part", "at", "value").select("value").write.mode("overwrite").text(path)


def rollup(notes: DataFrame, links: DataFrame, aliases: DataFrame, vectors: DataFrame, sessions: DataFrame, events: DataFrame, outcomes: DataFrame, performance: DataFrame, fingerprint: str, tier: str, exported_at: str) -> DataFrame:
    """One row that sums a collection up: counts, notes by type (unstructured without one), links, aliases, vectors with their most
    frequent length (ties: the longer), and each variant's performance as analytics.outcome_performance gives it. Nothing of a note's
    content or id is in it. Types and variants are few, so their counts make one map; all else is a count."""
    _checked(tier)
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unstructured"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(c)))
    types = notes.groupBy(kind.alias("type")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("note_count"), entries(F.struct("type", "n")).alias("type_distribution"))
    lengths = vectors.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("embedding_count"), F.coalesce(F.max_by("dims", F.struct("n", "dims")), F.lit(0)).alias("embedding_dims"))
    own = F.struct(F.col("events").alias("event_count"), F.col("outcomes").alias("outcome_count"), F.col("hit_5").alias("hit_at_5"), F.col("hit_10").alias("hit_at_10"), "mrr")
    variants = performance.agg(entries(F.struct("variant", own.alias("s"))).alias("variant_stats"))
    counted = [t.agg(F.count("*").alias(f"{k}_count")) for k, t in (("link", links), ("alias", aliases), ("session", sessions), ("event", events), ("outcome", outcomes))]
    row = reduce(lambda a, b: a.crossJoin(b), [types, lengths, variants, *counted])  # one row each
    return row.select(
        F.lit("rollup").alias("kind"), F.lit(VERSION).alias("schema_version"), F.lit(tier).alias("tier"), F.lit(fingerprint).alias("fingerprint"),
        *("note_count", "type_distribution", "link_count", "alias_count", "embedding_count", "embedding_dims", "variant_stats"),
        F.lit(exported_at).alias("exported_at"), *("session_count", "event_count", "outcome_count"),
    )
