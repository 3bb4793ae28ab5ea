"""Streaming forms of sessions and of the use of injected notes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users from a stream of (user, ts); each is given once its gap has passed the watermark."""
    return events.withWatermark("ts", late).groupBy("user", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended")).select("user", F.col("w.start").alias("started"), "ended", "n")


def consumed(injections: DataFrame, uses: DataFrame, within: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Injections (inj_id, key, ts) that a use (key, ts) follows within the time, each once.

    An interval join of two streams, of whose rows the first for each injection stays; state goes with the watermark."""
    i = injections.withWatermark("ts", late)
    u = uses.select(F.col("key").alias("u_key"), F.col("ts").alias("u_ts")).withWatermark("u_ts", late)
    met = i.join(u, F.expr(f"key = u_key AND u_ts >= ts AND u_ts <= ts + INTERVAL {within}")).select("inj_id", "key", "ts")
    return met.dropDuplicatesWithinWatermark(["inj_id"])


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


OFFER = "user string, ts timestamp, access boolean, event_id string, note string, variant string, rank int"
OUTCOME = "access_id string, event_id string, note string, variant string, rank int, ts timestamp"


class _History:
    """A user's rows that wait for the watermark, and the offers of the last sessions. All times are nanoseconds."""

    def __init__(self, window: int, gap: int, saved: str | None):
        self.window, self.gap = window, gap
        self.waiting, self.last, self.sessions = json.loads(saved) if saved else ([], None, [])

    def saved(self) -> str:
        return json.dumps([self.waiting, self.last, self.sessions])

    def passed(self, watermark: int):
        """Outcomes of the rows up to the watermark, in order of time; offers of one time come before accesses."""
        self.waiting.sort()
        n = sum(1 for row in self.waiting if row[0] <= watermark)
        ready, self.waiting = self.waiting[:n], self.waiting[n:]
        for ts, access, event, note, variant, rank in ready:
            if self.last is None or ts - self.last > self.gap:
                self.sessions = [*self.sessions, []][-self.window :]
            self.last = ts
            if access:
                for offers in self.sessions:
                    yield from ((event, e, note, v, r, ts) for e, n, v, r in offers if n == note)
            else:
                self.sessions[-1].append([event, note, variant, rank])


def outcomes(events: DataFrame, window: int = 2, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(access_id, event_id, note, variant, rank, ts): each access linked to the offers of its note in the user's last sessions.

    events is a stream of user, ts, access, event_id, note, variant, rank: an access, or an offer of a note at a rank of a
    variant, a row each. The access's own session and the ones before count, `window` in all; sessions end by a gap.
    Rows wait until the watermark has passed them, so results don't depend on how the stream is cut or ordered within
    `late`; rows later than that are dropped, and so are those without user or time. State holds a user's rows
    of `late` and the offers of `window` sessions, and goes once their gap has passed.
    """
    nanos = int(pd.Timedelta(gap).value)
    columns = [c.split()[0] for c in OFFER.split(", ")]

    def run(key, frames, state):
        held = _History(window, nanos, state.get[0] if state.exists else None)
        for frame in frames:
            times = frame["ts"].astype("datetime64[ns]").astype("int64")
            rows = zip(times, frame["access"].fillna(False).astype(bool), *(frame[c].astype(object).where(frame[c].notna(), None) for c in columns[3:]), strict=True)
            held.waiting += [[int(t), bool(a), e, n, v, None if r is None else int(r)] for t, a, e, n, v, r in rows]
        watermark = state.getCurrentWatermarkMs()
        found = list(held.passed(watermark * 1_000_000))
        if held.waiting or held.last is not None and watermark * 1_000_000 <= held.last + nanos * window:
            state.update((held.saved(),))
            wake = held.waiting[0][0] if held.waiting else held.last + nanos * window
            state.setTimeoutTimestamp(max(wake // 1_000_000, watermark) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"rank": "Int32"}).assign(ts=lambda x: pd.to_datetime(x["ts"]))

    rows = events.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in OFFER.split(", ")]).filter("user is not null and ts is not null")
    return rows.withWatermark("ts", late).groupBy("user").applyInPandasWithState(run, OUTCOME, "saved string", "append", "EventTimeTimeout")
