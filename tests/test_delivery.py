"""Decisions on texts, the counts of what was delivered, and conditions on events."""

import datetime

from pyspark.sql import functions as F

from quillspark.operators import delivery as D


def test_decisions(spark):
    cases = {  # confidence, asked, notes, tight, floor -> reason
        ("strong", True, 100, True, True): "pointers_only",
        ("no_match", True, 5, False, True): "pointers_only",
        ("no_match", False, 5, False, True): None,
        ("no_match", False, 5, False, False): "below_floor",
        ("no_match", False, 0, True, True): "below_floor",
        ("no_match", False, 30, True, True): "below_floor",
        ("weak", False, 100, False, True): "below_floor",
        ("weak", None, 100, True, True): None,
        ("moderate", False, 100, False, True): None,
        (None, False, 100, False, True): None,
    }
    df = spark.createDataFrame(list(cases), "c string, a boolean, n int, t boolean, f boolean")
    d = D.body_decision(*map(F.col, "cantf"))
    got = {tuple(r)[:5]: (r.d.delivered, r.d.reason, r.none.reason, r.json.delivered) for r in df.select("*", d.alias("d"), D.delivered_to(d, F.lit(False), F.lit(True)).alias("none"), D.delivered_to(d, F.lit(True), F.lit(True)).alias("json")).collect()}
    assert got == {k: (v is None, v, "below_floor", True) for k, v in cases.items()}


def test_packs_counts_and_log(spark):
    notes = spark.createDataFrame([(1, "{}", "a" * 40, "1"), (2, "{}", "b" * 20, "2"), (3, "{}", None, "3"), (4, "{}", "d" * 4000, "4"), (5, "{}", "", "5")], "id long, frontmatter string, body string, updated string")
    edges = spark.createDataFrame([(1, 2, "explicit_link", "high", 1), (1, 3, "explicit_link", "high", 2), (4, 1, "tag_overlap", "low", 3)], "src long, dst long, edge_type string, confidence string, at long")
    hits = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("q", 1, 4), ("r", 1, 5), ("s", 1, 1), ("none", 2, 1)], "question string, rank int, id long")
    pack = D.packs(hits, notes, edges, 100)
    got = {(r.question, r.position): (r.id, r.body and len(r.body), r.excerpted) for r in pack.collect()}
    assert got[("p", 0)] == (1, 40, False) and got[("q", 0)] == (4, 396, True) and got[("r", 0)] == (5, None, False)
    assert {v[0] for k, v in got.items() if k[0] == "p"} == {1, 2, 3, 4} == {v[0] for k, v in got.items() if k[0] == "s"} and {k[0] for k in got} == {"p", "q", "r", "s"}
    now = datetime.datetime(2024, 1, 1)
    asks = spark.createDataFrame([(x, now, "agent", "weak" if x == "s" else "strong", False, False, 100, False, True) for x in "pqrs"], "question string, ts timestamp, caller string, confidence string, pointers_only boolean, json boolean, notes int, tight boolean, floor_applied boolean")
    said = {r.question: (r.notes, r.delivered, r.excerpted, r.titles_only, r.phrase) for r in D.counts(pack, asks).collect()}
    assert said["p"] == (4, 2, 0, 2, "2 delivered in full, 2 titles only") and said["q"] == (1, 1, 1, 0, "1 delivered as excerpt") and said["r"] == (1, 0, 0, 1, "0 delivered")
    rows = {(r.question, r.note_id): (r.body_delivered, r.reason) for r in D.access_rows(pack, asks).collect()}
    assert rows[("p", 1)] == (True, None) and rows[("p", 3)] == (False, None) and rows[("s", 1)] == (False, "below_floor") == rows[("r", 5)]


def test_conditions_on_events(spark):
    at = lambda k: datetime.datetime(2024, 1, k)
    rows = [("a", "s1", at(1), "ask"), ("b", "s1", at(2), "search"), (None, "s2", at(3), "ask"), ("c", "s2", None, None)]
    df = spark.createDataFrame(rows, "caller string, session_id string, ts timestamp, kind string")
    ids = lambda **k: sorted(str(r.caller) for r in D.matching(df, **k).collect())
    assert ids() == ["None", "a", "b", "c"] and ids(callers=["a", "b"], since=at(2)) == ["b"] and ids(sessions=["s2"]) == ["None", "c"]
    assert ids(kinds=["ask"]) == ["None", "a"] and ids(without=["a", "c"]) == ["None", "b"] and ids(since=at(2)) == ["None", "b"]
    meter = spark.createDataFrame([("a", 4, 1), ("b", 0, 0)], "caller string, injected long, consumed long")
    assert {r.caller: r.rate for r in D.consumed_rate(meter).collect()} == {"a": 0.25, "b": 0.0}
