"""Streamed outcomes, consumed injections and distinct events against batch results."""

import datetime
import random

from quillspark.streaming import sessions as S

ZERO = datetime.datetime(2024, 3, 1)


def at(minutes):
    return ZERO + datetime.timedelta(minutes=minutes)


def fed(spark, tmp_path, schema, batches, query):
    """The rows of a query over files that arrive one by one."""
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        stream = query(spark.readStream.schema(schema).json(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def linked(rows, window, gap=30):
    """All links by going through each user's rows in order of time."""
    out = []
    for user in {r[0] for r in rows if r[0]}:
        last, sessions = None, []
        for r in sorted((r for r in rows if r[0] == user and r[1]), key=lambda r: (r[1], r[2])):
            if last is None or r[1] - last > datetime.timedelta(minutes=gap):
                sessions = [*sessions, []][-window:]
            last = r[1]
            if r[2]:
                out += [(r[3], o[3], o[4], o[5], o[6], r[1]) for s in sessions for o in s if o[4] == r[4]]
            else:
                sessions[-1].append(r)
    return sorted(out)


def test_outcomes_equal_those_of_the_whole(spark, tmp_path):
    r = random.Random(7)
    rows = []
    for i in range(160):
        access = r.random() < 0.4
        rows.append((r.choice("ab"), at(r.randrange(600)), access, f"e{i}", r.choice("xyz"), None if access else r.choice(("none", "spread")), None if access else r.randrange(9)))
    rows.sort(key=lambda x: x[1] + datetime.timedelta(minutes=r.randrange(25)))  # late by less than the bound
    rows += [(None, at(1), True, "n", "x", None, None), ("a", None, True, "n", "x", None, None)]
    end = [(u, at(5000), False, "end", "q", "none", 1) for u in "ab"]
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)] + [end, [("c", at(9000), False, "z", "q", "none", 1)]]
    found = fed(spark, tmp_path, S.OFFER, batches, lambda s: S.outcomes(s, late="1 hour"))
    got = sorted((x.access_id, x.event_id, x.note, x.variant, x.rank, x.ts) for x in found)
    assert got == linked(rows, 2) and len(got) > 30


def test_injections_count_once(spark, tmp_path):
    schema = "inj boolean, id string, key string, ts timestamp"
    rows = [(True, "i1", "k", at(0)), (True, "i2", "k", at(50)), (True, "i3", "m", at(0)), (False, "u1", "k", at(5)), (False, "u2", "k", at(6)), (False, "u3", "k", at(30)), (False, "u4", "m", at(31))]
    batches = [rows, [(False, "e", "q", at(500)), (True, "e", "q", at(500))], [(False, "f", "q", at(900)), (True, "f", "q", at(900))]]
    found = fed(spark, tmp_path, schema, batches, lambda s: S.consumed(s.filter("inj").selectExpr("id as inj_id", "key", "ts"), s.filter("not inj").select("key", "ts")))
    assert sorted(x.inj_id for x in found if x.key != "q") == ["i1"]


def test_events_count_once(spark, tmp_path):
    found = fed(spark, tmp_path, "event_id string, ts timestamp", [[("a", at(0)), ("b", at(1)), ("a", at(0))], [("a", at(3)), ("c", at(4))]], S.distinct_events)
    assert sorted(x.event_id for x in found) == ["a", "b", "c"]
