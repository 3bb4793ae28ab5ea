"""Order of discovery against a plain queue; snippets against a plain window."""

import random
import re
from collections import deque

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators.traversal import traverse

LEVEL = {"low": 1, "medium": 2, "high": 3}


def queue(edges, start, depth, most, least):
    """A plain breadth-first search, as its contract says."""
    near = {}
    for s, d, kind, conf, w in edges:
        if s is not None and d is not None and (least is None or LEVEL.get(conf, 0) >= LEVEL[least]):
            for way, a, b in ((0, s, d), (1, d, s)):
                near.setdefault(a, {}).setdefault(b, []).append((way, kind, conf, w))
    out, todo, seen = [(start, 0, None, None, None)], deque([(start, 0)]), {start}
    while todo and not (most and len(out) >= most):
        at, d = todo.popleft()
        for _, b, (way, kind, _, _) in sorted((min(es)[0], b, min(es)) for b, es in near.get(at, {}).items()) if d < depth else []:
            if b not in seen:
                seen.add(b)
                out.append((b, d + 1, at, at if way == 0 else b, kind))
                todo.append((b, d + 1))
                if most and len(out) >= most:
                    break
    return out


def test_discovery_order_equals_a_queue(spark):
    r = random.Random(3)
    name = lambda: f"n{r.randrange(40)}"
    edges = [(name(), name(), r.choice(("a", "b")), r.choice(("low", "medium", "high")), r.choice((0.5, 1.0))) for _ in range(70)]
    edges += [("hub", f"n{i}", "a", "high", 1.0) for i in range(40)] + [(f"n{i}", "hub", "b", "low", 1.0) for i in range(0, 40, 3)]
    edges += [("n1", None, "a", "high", 1.0), (None, "n1", "a", "high", 1.0), ("n2", "n2", "a", "high", 1.0), ("n3", "n4", "a", "odd", 1.0), edges[0]]
    df = spark.createDataFrame(edges, "src string, dst string, edge_type string, confidence string, weight double").repartition(3)
    starts = spark.createDataFrame([("hub",), ("n1",), ("n2",), ("n2",), ("nowhere",), (None,)], "start string")
    for depth, most, least in ((2, None, None), (3, 12, None), (3, None, "medium"), (1, 1, None), (0, None, None)):
        found = {}
        for x in traverse(df, starts, depth, most, least).collect():
            found.setdefault(x.start, []).append((x.n, (x.id, x.distance, x.parent, x.source, x.edge_type)))
        for start in ("hub", "n1", "n2", "nowhere"):
            want = queue(edges, start, depth, most, least)
            assert sorted(found[start], key=lambda x: x[0]) == list(enumerate(want)), (start, depth, most, least)
        assert len(found) == 4


def window(text, words, size):
    if text is None:
        return None
    pieces = re.findall(r"[^\W_]+[\W_]*", text)
    own = [re.match(r"[^\W_]+", p)[0].lower() for p in pieces]
    hits = [i for i, w in enumerate(own) if w in words]
    begin = 0
    if hits:
        inside = lambda i: [j for j in hits if i <= j < i + size]
        i = max(hits, key=lambda i: (len({own[j] for j in inside(i)}), len(inside(i)), -i))
        begin = i - (size - (inside(i)[-1] - i + 1)) // 2
    begin = max(0, min(begin, len(pieces) - size))
    shown = re.sub(r"[\W_]+$", "", "".join(pieces[begin : begin + size]))
    return ("..." if begin > 0 else "") + shown + ("..." if begin + size < len(pieces) else "")


def test_snippets_are_the_best_windows(spark):
    r = random.Random(6)
    words = ["red", "Blue", "stone", "été", "x1", "in", "of"]
    texts = ["".join(r.choice(words) + r.choice((" ", ", ", "\n", "-")) for _ in range(n)) for n in (0, 1, 3, 8, 20, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "...", "no such", "red"])]
    df = spark.createDataFrame(rows, "id int, text string")
    for query in (["red", "of"], ["été"], ["absent"]):
        got = {x.id: x.s for x in df.select("id", R.best_window(F.col("text"), query, 7).alias("s")).collect()}
        assert got == {i: window(t, query, 7) for i, t in rows}


def test_numbers_follow_the_ids(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    got = R.numbered(spark.createDataFrame([(i, 0) for i in ids], "id long, range int").drop("range")).collect()
    assert [x.id for x in sorted(got, key=lambda x: x["at"])] == sorted(ids) and sorted(x["at"] for x in got) == list(range(500))
