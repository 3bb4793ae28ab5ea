"""What an answer hands over: packs around the best hits of many questions, whose texts are delivered, and the log of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packing as P

# Why texts are withheld, who reads on their own, and the least number of notes that a floor is measured on.
BY_CALLER, BELOW_FLOOR, AGENT, MIN_NOTES = "pointers_only", "below_floor", "agent", 30


def body_decision(confidence: Column, asked: Column, notes: Column, tight: Column, floor_applied: Column) -> Column:
    """(delivered, reason): whether a text answer shows texts, and which rule withholds them.

    asked: the caller wants ids only, which always holds. A collection of fewer notes than a floor is measured on isn't
    judged. Without a match nothing is shown; a weak match is shown only in a tight collection, where none can be strong."""
    small = F.coalesce(floor_applied, F.lit(False)) & (notes > 0) & (notes < MIN_NOTES)
    reason = (
        F.when(F.coalesce(asked, F.lit(False)), BY_CALLER)
        .when(small, F.lit(None))
        .when(confidence == "no_match", BELOW_FLOOR)
        .when((confidence == "weak") & ~F.coalesce(tight, F.lit(False)), BELOW_FLOOR)
    )
    return F.struct(reason.isNull().alias("delivered"), reason.alias("reason"))


def delivered_to(decision: Column, has_text: Column, json: Column) -> Column:
    """(delivered, reason): whether text reached the caller. JSON carries texts whatever a text answer would show."""
    reached = F.coalesce(has_text, F.lit(False))
    reason = F.when(~reached, BELOW_FLOOR).when(F.coalesce(json, F.lit(False)), F.lit(None)).otherwise(decision["reason"])
    return F.struct(reason.isNull().alias("delivered"), reason.alias("reason"))


def packs(hits: DataFrame, notes: DataFrame, edges: DataFrame, budget: int, max_items: int = 0, excerpt_tokens: int = 0) -> DataFrame:
    """(question, position, id, edge_type, fm_tokens, body, body_tokens, excerpted) of the pack around each question's first hit.

    hits: question, rank, id. notes and edges as the packing takes them. Position 0 is the hit itself. With max_items the
    pack is filled item by item, else by frontmatter first. Questions with one first hit share its pack's computation."""
    first = hits.filter("rank = 1").select("question", F.col("id").alias("target"))
    wanted = first.select("target").distinct()
    texts = notes.join(wanted.withColumnRenamed("target", "id"), "id", "left_semi")
    packed = P.targets(texts, budget, excerpt_tokens)
    near = P.direct_candidates(edges).join(wanted, "target", "left_semi")
    fill = (lambda *a: P.body_first(*a, max_items, excerpt_tokens)) if max_items else (lambda *a: P.two_pass(*a, budget, excerpt_tokens))
    items = P.bodies(fill(packed, near, notes), notes, excerpt_tokens).select("target", "position", "id", "edge_type", "fm_tokens", "body", "body_tokens")
    own = packed.select("target", F.lit(0).alias("position"), F.col("target").alias("id"), F.lit(None).cast("string").alias("edge_type"), "fm_tokens", F.when(F.col("body") != "", F.col("body")).alias("body"), F.when(F.col("body") != "", F.col("body_tokens")).alias("body_tokens"))
    whole = notes.select("id", F.col("body").alias("whole"))
    rows = own.unionByName(items).join(whole, "id").withColumn("excerpted", F.coalesce(F.col("body") != F.col("whole"), F.lit(False)))
    return first.join(rows.drop("whole"), "target").drop("target")


def counts(pack: DataFrame, asks: DataFrame) -> DataFrame:
    """(question, notes, delivered, excerpted, titles_only, phrase) of packs under asks (question, pointers_only, ...)."""
    shown = ~F.coalesce("pointers_only", F.lit(False)) & F.col("body").isNotNull()
    rows = pack.join(asks.select("question", "pointers_only"), "question")
    found = rows.groupBy("question").agg(F.count("*").alias("notes"), F.sum(shown.cast("long")).alias("delivered"), F.sum((shown & F.col("excerpted")).cast("long")).alias("excerpted"))
    found = found.withColumn("titles_only", F.col("notes") - F.col("delivered"))
    n, cut, titles = F.col("delivered"), F.col("excerpted"), F.col("titles_only")
    many = lambda c: F.when(c == 1, "").otherwise("s")
    how = F.when(n == 0, "").when(cut == n, F.concat(F.lit(" as excerpt"), many(cut))).when(cut > 0, F.concat(F.lit(", "), cut.cast("string"), F.lit(" as excerpt"), many(cut))).otherwise(" in full")
    rest = F.when((titles > 0) & (n > 0), F.concat(F.lit(", "), titles.cast("string"), F.lit(" title"), many(titles), F.lit(" only"))).otherwise("")
    return found.withColumn("phrase", F.concat(n.cast("string"), F.lit(" delivered"), how, rest))


def access_rows(pack: DataFrame, asks: DataFrame) -> DataFrame:
    """(question, note_id, ts, caller, body_delivered, reason): a row of the access log for each note of each pack.

    asks: question, ts, caller, confidence, pointers_only, json, notes, tight, floor_applied. A pack without any text delivers
    none; a note without text in it isn't delivered either. A question without a hit logs nothing."""
    decision = body_decision(F.col("confidence"), F.col("pointers_only"), F.col("notes"), F.col("tight"), F.col("floor_applied"))
    any_text = F.max(F.col("body").isNotNull()).over(Window.partitionBy("question"))
    rows = pack.withColumn("has_text", any_text).join(asks, "question").withColumn("to", delivered_to(decision, F.col("has_text"), F.col("json")))
    return rows.select("question", F.col("id").alias("note_id"), "ts", "caller", (F.col("to.delivered") & F.col("body").isNotNull()).alias("body_delivered"), F.col("to.reason").alias("reason"))


def delivered_notes(accesses: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, accesses, last, title, type) of notes whose text reached someone, the log (note_id, ts, caller, body_delivered).

    Rows from before delivery was logged are null and count if the caller read on its own."""
    counted = accesses.filter(F.coalesce("body_delivered", F.col("caller") == AGENT)).groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last"))
    return counted.join(notes.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("type", F.lit("")).alias("type")), "id")


def matching(events: DataFrame, callers: list[str] | None = None, sessions: list[str] | None = None, since=None, kinds: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Events (caller, session_id, ts, kind) under the conditions given; `since` is included, `without` are callers left out."""
    conditions = [F.col(c).isin(*v) for c, v in (("caller", callers), ("session_id", sessions), ("kind", kinds)) if v]
    conditions += [F.col("ts") >= F.lit(since)] if since is not None else []
    conditions += [~F.coalesce(F.col("caller").isin(*without), F.lit(False))] if without else []
    for c in conditions:
        events = events.filter(c)
    return events


def consumed_rate(meter: DataFrame) -> DataFrame:
    """(caller, injected, consumed, rate) of a meter with these sums; 0 where nothing was injected."""
    return meter.withColumn("rate", F.when(F.col("injected") > 0, F.col("consumed") / F.col("injected")).otherwise(0.0))
