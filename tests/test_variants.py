"""Variants' ranks against plain sorts, and payloads that come back as they were."""

import json
import random

import pytest

from pyspark.sql import functions as F

from quillspark.operators import analytics as A
from quillspark.operators.variants import Variants


def test_ranks_and_payloads(spark):
    r = random.Random(1)
    rows = [(f"e{e}", f"n{i}", i, r.choice((None, 0.5, 1.0, 2.0)), r.random()) for e in range(8) for i in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "event_id string, note_id string, position int, a double, b double").repartition(3)
    v = Variants(a=F.col("a"))
    v.register("sum", F.coalesce("a", F.lit(0.0)) + F.col("b"))
    scores = {"none": lambda x: -x[2], "a": lambda x: x[3], "sum": lambda x: (x[3] or 0) + x[4]}
    want = {}
    for e in {x[0] for x in rows}:
        for name, of in scores.items():
            own = sorted((x for x in rows if x[0] == e), key=lambda x: (of(x) is None, -(of(x) or 0), x[2]))
            want[e, name] = [x[1] for x in own]
    got = v.ranked(df, "a", ["sum", "none", "a"])
    lists = {}
    for x in got.collect():
        lists.setdefault((x.event_id, x.variant), {})[x.rank] = x.note_id
        assert x.primary_variant == "a"
    assert {k: [n for _, n in sorted(p.items())] for k, p in lists.items()} == want
    data = v.payloads(df, "a", ["sum", "none"], k=3)
    back = {(x.event_id, x.variant): tuple(x.notes) for x in A.rank_lists(A.payload(data)).collect()}
    assert back == {k: tuple(x[:3]) for k, x in want.items()}
    assert all(set(json.loads(x.event_data)["variants"]) == {"a", "sum", "none"} for x in data.collect())
    assert v.payloads(df.limit(0), "a").collect() == []
    with pytest.raises(ValueError):
        v.ranked(df, "other")
