"""Usage analytics over access, session and outcome logs; every clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import combined, retrieval_strength


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def activation(accesses: DataFrame, now: str, decay: float = 0.5, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """(id, n, retrieval, storage, activation) from accesses (id, ts) up to now."""
    hours = (seconds(F.to_timestamp(F.lit(now))) - seconds(F.col("ts"))) / 3600
    rows = accesses.groupBy("id").agg(F.count("*").alias("n"), retrieval_strength(hours, decay).alias("retrieval")).withColumn("storage", F.log1p("n"))
    return rows.withColumn("activation", combined(F.col("retrieval"), F.col("storage"), alpha=alpha, beta=beta))


def sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    """Events (user, ts) with the number of their user's session; a gap of exactly `gap` seconds goes on."""
    w = Window.partitionBy("user").orderBy("ts", "event_id")
    new = F.coalesce((seconds(F.col("ts")) - seconds(F.lag("ts").over(w)) > gap).cast("int"), F.lit(1))
    return events.withColumn("session_no", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def session_spans(events: DataFrame, gap: int = 1800) -> DataFrame:
    return sessions(events, gap).groupBy("user", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def gaps(spans: DataFrame) -> DataFrame:
    """Whole seconds between the starts of a user's successive sessions."""
    w = Window.partitionBy("user").orderBy("started")
    return spans.withColumn("gap", F.round(seconds(F.col("started")) - seconds(F.lag("started").over(w))).cast("long")).filter("gap is not null")


def merged(intervals: DataFrame) -> DataFrame:
    """Unions of overlapping intervals (key, start, end)."""
    w = Window.partitionBy("key").orderBy("start", "end")
    new = F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    return intervals.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def active_hours(intervals: DataFrame, since: DataFrame, now: str, gamma: float) -> DataFrame:
    """For rows (key, id, ts): hours from ts to now within the key's intervals, plus gamma times the rest."""
    islands, end = merged(intervals), seconds(F.to_timestamp(F.lit(now)))
    part = F.greatest(F.lit(0.0), F.least(seconds(F.col("end")), end) - F.greatest(seconds(F.col("start")), seconds(F.col("ts"))))
    rows = since.join(islands, "key", "left").groupBy("key", "id", "ts").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("active"))
    return rows.withColumn("hours", (F.col("active") + gamma * (end - seconds(F.col("ts")) - F.col("active"))) / 3600)


def consumed(injections: DataFrame, uses: DataFrame, within: int = 1800) -> DataFrame:
    """Injections (key, ts, ...) with whether a use (key, ts) follows within so many seconds, both ends included.

    Both sides are cut in bins of the window's length, so a hot key's rows are dealt over time, and the
    join is on key and bin; a use is in the injection's bin or the next.
    """
    at = F.floor(seconds(F.col("ts")) / within).cast("long")
    left = injections.withColumn("bin", F.explode(F.array(at, at + 1)))
    right = uses.select(F.col("key").alias("u_key"), F.col("ts").alias("u_ts"), at.alias("u_bin"))
    hit = left.join(right, (F.col("key") == F.col("u_key")) & (F.col("bin") == F.col("u_bin")) & (F.col("u_ts") >= F.col("ts")) & (seconds(F.col("u_ts")) <= seconds(F.col("ts")) + within), "left_semi")
    return injections.join(hit.select("inj_id").distinct().withColumn("consumed", F.lit(True)), "inj_id", "left").withColumn("consumed", F.coalesce("consumed", F.lit(False)))


def hit_mrr(ranks: DataFrame, total: Column | int | None, k: int) -> DataFrame:
    """Hit@k and mean reciprocal rank by variant, over `total` events, all of ranks if none is given; ranks: (event_id, variant, rank), least rank counts."""
    best = ranks.groupBy("event_id", "variant").agg(F.min("rank").alias("rank"))
    sums = best.groupBy("variant").agg(F.sum((F.col("rank") <= k).cast("int")).alias("hits"), F.sum(1.0 / F.col("rank")).alias("reciprocal"))
    if total is None:
        sums, total = sums.crossJoin(F.broadcast(ranks.agg(F.count_distinct("event_id").alias("total")))), F.col("total")  # one row
    return sums.select("variant", (F.col("hits") / total).alias("hit_at_k"), (F.col("reciprocal") / total).alias("mrr"))


def jaccard_at(a: Column, b: Column, k: int) -> Column:
    """Of two lists' first k; 1 if both are empty, and without a k the longer list's length counts."""
    x, y = (F.slice(a, 1, k), F.slice(b, 1, k)) if k > 0 else (a, b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def kendall(ranks: DataFrame) -> DataFrame:
    """Kendall's tau-a by key of (key, id, rank_a, rank_b); null with fewer than two common ids."""
    a, b = ranks.alias("a"), ranks.alias("b")
    sign = F.signum((F.col("a.rank_a") - F.col("b.rank_a")) * (F.col("a.rank_b") - F.col("b.rank_b")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.key").alias("key")).agg(F.sum(sign).alias("s"), F.count("*").alias("n"))
    return ranks.select("key").distinct().join(pairs, "key", "left").select("key", (F.col("s") / F.col("n")).alias("tau"))


def recovered(sessions_: DataFrame, events: DataFrame) -> DataFrame:
    """Ends of sessions without one: the last event, else a minute after the start."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last"))
    return sessions_.join(last, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", "last", F.col("started_at") + F.expr("INTERVAL 1 MINUTE"))).drop("last")


def payload(events: DataFrame) -> DataFrame:
    """(event_id, variant, note_id, rank) of events' JSON {"variants": {name: {"results": [...]}}}; malformed rows give none."""
    kind = "struct<variants:map<string,struct<results:array<struct<note_id:string,rank:int,score_final:double,note_type:string,path:string>>>>>"
    parsed = events.withColumn("p", F.from_json("event_data", kind))
    each = parsed.select("event_id", F.explode("p.variants").alias("variant", "v"))
    return each.select("event_id", "variant", F.explode("v.results").alias("r")).select("event_id", "variant", "r.note_id", "r.rank")


def rank_lists(results: DataFrame) -> DataFrame:
    """(event_id, variant, notes): each event's and variant's notes of (event_id, variant, note_id, rank) by rank, a repeated note at its best."""
    best = results.groupBy("event_id", "variant", "note_id").agg(F.min("rank").alias("rank"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "note_id"))), lambda x: x["note_id"])
    return best.groupBy("event_id", "variant").agg(listed.alias("notes"))


def tau_shared(a: Column, b: Column) -> Column:
    """Kendall's tau-a over two lists' common ids, within the row; null with fewer than two. Lists are pages of results, so pairs of places are few."""
    places = F.transform(F.array_intersect(a, b), lambda x: F.array_position(b, x))
    signs = F.flatten(F.transform(places, lambda p, i: F.transform(F.slice(places, i + 2, F.size(places)), lambda q: F.signum(q - p))))
    return F.when(F.size(signs) > 0, F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / F.size(signs))


def comparisons(results: DataFrame, primary: DataFrame, k: int) -> DataFrame:
    """(event_id, primary_variant, shadow_variant, jaccard, tau, shared) of each event's primary list with each other one. primary: (event_id, primary_variant), null or empty for none."""
    lists = rank_lists(results)
    first = lists.join(primary.filter("primary_variant <> ''"), "event_id").filter("variant = primary_variant").select("event_id", "primary_variant", F.col("notes").alias("a"))
    pairs = first.join(lists.select("event_id", F.col("variant").alias("shadow_variant"), F.col("notes").alias("b")), "event_id").filter("shadow_variant <> primary_variant")
    a, b = F.col("a"), F.col("b")
    return pairs.select("event_id", "primary_variant", "shadow_variant", jaccard_at(a, b, k).alias("jaccard"), tau_shared(a, b).alias("tau"), F.size(F.array_intersect(a, b)).alias("shared"))


def mean_comparisons(compared: DataFrame) -> DataFrame:
    """Mean Jaccard and tau by pair of variants; events without a tau count in the first only."""
    return compared.groupBy("primary_variant", "shadow_variant").agg(F.count("*").alias("events"), F.avg("jaccard").alias("jaccard"), F.avg("tau").alias("tau"), F.count("tau").alias("tau_events"))


def outcome_performance(primary: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(variant, events, outcomes, hit_5, hit_10, mrr) of events (event_id, primary_variant) and the outcomes (event_id, variant, rank) of their own variant; zeros without outcomes."""
    events = primary.filter("primary_variant <> ''")
    own = outcomes.join(events, "event_id").filter("variant = primary_variant")
    hit = lambda k: F.avg(F.col("rank").between(1, k).cast("double"))
    sums = own.groupBy("variant").agg(F.count("*").alias("outcomes"), hit(5).alias("hit_5"), hit(10).alias("hit_10"), F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
    counts = events.groupBy(F.col("primary_variant").alias("variant")).agg(F.count("*").alias("events"))
    return counts.join(sums, "variant", "left").fillna(0).select("variant", "events", "outcomes", "hit_5", "hit_10", "mrr")


def recent_windows(spans: DataFrame, most: int = 100) -> DataFrame:
    """One row: the newest `most` ended windows (started, ended) as disjoint intervals of seconds, in order."""
    newest = spans.filter("ended is not null").orderBy(F.desc("started"), F.desc("ended")).limit(most).select(F.lit(0).alias("key"), F.col("started").alias("start"), F.col("ended").alias("end"))
    return merged(newest).agg(F.array_sort(F.collect_list(F.struct(seconds(F.col("start")).alias("start"), seconds(F.col("end")).alias("end")))).alias("windows"))


def compressed_activation(accesses: DataFrame, spans: DataFrame, now: str, gamma: float, decay: float = 0.5, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """activation() with idle time, that outside the recent windows, counted by gamma only. The windows are a bounded list, broadcast to the accesses."""
    end, at = seconds(F.to_timestamp(F.lit(now))), seconds(F.col("ts"))
    each = F.transform("windows", lambda w: F.greatest(F.lit(0.0), F.least(w["end"], end) - F.greatest(w["start"], at)))
    active = F.when(end > at, F.aggregate(each, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    total = F.greatest(end - at, F.lit(0.0))
    rows = accesses.crossJoin(F.broadcast(recent_windows(spans))).select("id", ((active + gamma * (total - active)) / 3600).alias("hours"))
    scored = rows.groupBy("id").agg(F.count("*").alias("n"), retrieval_strength(F.col("hours"), decay).alias("retrieval")).withColumn("storage", F.log1p("n"))
    return scored.withColumn("activation", combined(F.col("retrieval"), F.col("storage"), alpha=alpha, beta=beta))
