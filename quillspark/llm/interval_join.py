"""Overlap joins of intervals: sales against the sessions of clicks of the same client, by Allen's relations.

The join splits into two disjoint range joins: a session starts within a sale's interval, or a sale starts strictly
within a session's. Only the interval side is spread over buckets of slots, and only over those in which its client has
points. Everything is compared in slots, so equal intervals of a client are one row with counts before any join: a
client with a third of all rows has no more rows than there are pairs of slots, and no pair of single rows is made.

Defined results: rows without client, start or click time are ignored; equal rows of a sale (id, client, start, open)
count once; lines of unknown or null sales and null shipping times are ignored; a shipping time before the sale changes
nothing; a null kind is no error and a null status isn't open; empty tables give no rows. Columns other than those named
aren't read, so they may have any name. Times without a zone are taken as they stand, others in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP = 15 * 60 * 1_000_000
SLOT = 6 * 3600 * 1_000_000
#: Slots in a bucket of the joins: a week of six hours each.
WIDTH = 28
#: The end of an open interval; all open ends are equal and later than any slot.
OPEN = 1 << 62
PIECES = 96


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970; of a time without a zone no zone is applied, whatever the session's is."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    days = F.datediff(F.col(name).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(name)) * 60 + F.minute(name)) * 60_000_000 + (F.extract(F.lit("SECOND"), F.col(name)) * 1_000_000).cast("long")


def floored(x: Column, by: int) -> Column:
    """x divided by a whole number, rounded down, also below 0, in whole numbers."""
    return ((x - F.pmod(x, F.lit(by).cast("long"))) / by).cast("long")


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """(client_id, first, last, error): runs of clicks at most a gap apart; error: a click at the last time has that kind.

    Clicks of one client in one span of the gap's length always belong together, so they are summed up before the first
    shuffle. Runs of these pieces are found for each client and day; only those that reach over midnight are put
    together for each client, so that no window holds more than a few rows for each day.
    """
    span = lambda x: floored(x, gap)
    rows = clicks.select("client_id", micros(clicks, "ts").alias("t"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error"))
    pieces = rows.dropna(subset=["client_id", "t"]).groupBy("client_id", span(F.col("t")).alias("piece")).agg(F.min("t").alias("first"), F.max(F.struct("t", "error")).alias("end"))
    day = floored(F.col("piece"), PIECES)
    copied = F.when(F.pmod("piece", F.lit(PIECES)) == PIECES - 1, F.array(day, day + 1)).otherwise(F.array(day))
    in_day = Window.partitionBy("client_id", "day").orderBy("piece")
    before = F.lag("end.t").over(in_day)
    flagged = pieces.withColumn("day", F.explode(copied)).withColumn("starts", F.coalesce(F.col("first") - before > gap, F.lit(True)))
    runs = flagged.withColumn("run", F.sum(F.col("starts").cast("int")).over(in_day)).filter(day == F.col("day"))
    runs = runs.groupBy("client_id", "day", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.max("starts").alias("starts"))
    at_midnight = ~F.col("starts") | (F.pmod(span(F.col("end.t")), F.lit(PIECES)) == PIECES - 1)
    in_client = Window.partitionBy("client_id").orderBy("day", "run")
    edges = runs.filter(at_midnight).withColumn("run", F.sum(F.col("starts").cast("int")).over(in_client))
    joined = edges.groupBy("client_id", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    cols = ("client_id", "first", F.col("end.t").alias("last"), F.col("end.error").alias("error"))
    return runs.filter(~at_midnight).select(*cols).unionByName(joined.select(*cols))


def sale_spans(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first, last, open): from the sale to the latest of it and its lines' shipping."""
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("t")).dropna().groupBy("sale_id").agg(F.max("t").alias("shipped"))
    one = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    one = one.dropna(subset=["client_id", "first"]).distinct()
    return one.join(shipped.hint("merge"), "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def slots(open_: str, slot: int = SLOT) -> list[Column]:
    """The slots of an interval's start and end, both inclusive; OPEN ends an open one."""
    return [floored(F.col("first"), slot).alias("s"), F.when(F.col(open_), F.lit(OPEN)).otherwise(floored(F.col("last"), slot)).alias("e")]


def points_within(intervals: DataFrame, points: DataFrame, lo: Column, hi: Column, at: Column, key: str, width: int = WIDTH) -> DataFrame:
    """Interval and point of the same key with lo <= at <= hi; the intervals alone are spread over buckets.

    An interval goes to those buckets only in which its key has points, so that far or open ends cost nothing."""
    placed = points.withColumn("bucket", floored(at, width))
    held = placed.groupBy(key).agg(F.collect_set("bucket").alias("buckets"))
    mine = intervals.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    reach = F.filter("buckets", lambda b: (b >= floored(F.col("lo"), width)) & (b <= floored(F.col("hi"), width)))
    spread = mine.join(held.hint("merge"), key).withColumn("bucket", F.explode(reach)).drop("buckets")
    return spread.join(placed.hint("merge"), [key, "bucket"]).filter(at.between(F.col("lo"), F.col("hi"))).drop("bucket", "lo", "hi")


def relation(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Allen's relation of [s, e] to [s2, e2], which share a slot; both ends count."""
    names = {-1: ("overlaps", "finished_by", "contains"), 0: ("starts", "equals", "started_by"), 1: ("during", "finishes", "overlapped_by")}
    end = lambda x: F.when(e < e2, x[0]).when(e == e2, x[1]).otherwise(x[2])
    return F.when(s < s2, end(names[-1])).when(s == s2, end(names[0])).otherwise(end(names[1]))


def related(spans: DataFrame, others: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each distinct (client_id, s, e) of spans and each relation: the others that share a slot with it.

    spans: client_id, s, e. others: client_id, s, e and a number crc. Gives n_pairs, overlap_slots (null for two open
    ends) and sessions_crc, each summed over the others."""
    one = spans.select("client_id", "s", "e").distinct()
    two = others.groupBy("client_id", F.col("s").alias("s2"), F.col("e").alias("e2")).agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    s, e, s2, e2 = map(F.col, ("s", "e", "s2", "e2"))
    pairs = points_within(one, two, s, e, s2, "client_id", width).unionByName(points_within(two, one, s2 + 1, e2, s, "client_id", width))
    shared = F.when((e == OPEN) & (e2 == OPEN), None).otherwise(F.least(e, e2) - F.greatest(s, s2) + 1)
    sums = F.sum("n").alias("n_pairs"), F.sum(shared * F.col("n")).alias("overlap_slots"), F.sum("crc").alias("sessions_crc")
    return pairs.withColumn("relation", relation(s, e, s2, e2)).groupBy("client_id", "s", "e", "relation").agg(*sums)


def sales_and_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) for each sale that shares a slot with a session."""
    spans = sale_spans(sales, lines).select("sale_id", "client_id", *slots("open"))
    others = sessions(clicks).select("client_id", *slots("error"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))
    found = spans.join(related(spans, others, width).hint("merge"), ["client_id", "s", "e"])
    sums = [F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")]
    return found.groupBy("sale_id", "relation").agg(*sums)
