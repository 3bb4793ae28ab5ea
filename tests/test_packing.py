"""Context packs with and without excerpts against a plain version, and the excerpt's rules."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import checks, graph, packing, retrieval

LONG = "First it says this. Then it says that!  And then, at last, a longer sentence closes the paragraph off. End."
BODIES = [
    LONG, None, "", "---\nid: x\n---\n# Head\n\nOne two. Three four.", "## Trigger\n\nA story.\n\n## PRINCIPLE\nDo this.\nAlways so.\n## Push\nno",
    "http://a.b/c\n\n- item\n\n- other", "oneword" * 20, "words without an end " * 9, "é" * 50 + ". ü", "x", LONG * 3, "---\nopen. fence",
]
KINDS = [("explicit_relation", "high", 0), ("explicit_link", "high", 1), ("tag_overlap", "medium", 2), ("tag_overlap", "low", 3)]


def cost(s):
    return (len(s.encode()) + 3) // 4


def plain_excerpt(body, most):
    """Excerpts of these bodies by hand: passages are listed, cuts are done one by one."""
    passage = {3: "One two. Three four.", 4: "Do this. Always so.", 5: "- item", 11: "--- open. fence"}.get(BODIES.index(body), body.strip())
    if cost(passage) <= most:
        return passage
    kept, start, pieces = "", 0, []
    for i in range(len(passage) - 1):
        if passage[i] in ".!?" and passage[i + 1] == " ":
            pieces.append(passage[start : i + 1].strip())
            start = i + 1
    for s in [*pieces, passage[start:].strip()]:
        if cost((kept + " " + s).strip()) > most:
            break
        kept = (kept + " " + s).strip()
    if kept:
        return kept
    for w in passage.split():
        if cost((kept + " " + w).strip() + "…") > most:
            break
        kept = (kept + " " + w).strip()
    return kept + "…" if kept else ""


def plain_pack(notes, edges, target, budget, cap, items):
    front, body, _ = notes[target]
    left = budget - cost(front)
    if left > 0 and body:
        e = plain_excerpt(body, min(cap, left)) if cap else ""
        left -= cost(e) if e else min(cost(body), left)
    found = {}
    for way in (0, 1):
        for at, (src, dst, kind) in enumerate(edges):
            here, there = (src, dst) if way == 0 else (dst, src)
            if here == target != there and there in notes:
                found.setdefault(there, (KINDS[kind][2], at, way))
    order = sorted(sorted(found, key=lambda i: (found[i][2], found[i][1])), key=lambda i: notes[i][2], reverse=True)
    order.sort(key=lambda i: found[i][0])
    out, state = [], [left]

    def attach(i):
        b = notes[i][1]
        if not b or state[0] <= 0:
            return None
        e = plain_excerpt(b, min(cap, state[0])) if cap else b
        if not e or cost(e) > state[0]:
            return None
        state[0] -= cost(e)
        return e

    if left <= 0:
        return []
    for i in order[: items or len(order)]:
        if cost(notes[i][0]) > state[0]:
            break
        state[0] -= cost(notes[i][0])
        out.append([i, attach(i) if items else None])
    for x in [] if items else out:
        x[1] = attach(x[0])
    return [(target, n + 1, i, b) for n, (i, b) in enumerate(out)]


@pytest.mark.parametrize("cap", [0, 6, 30])
@pytest.mark.parametrize("items", [0, 3])
def test_packs_equal_plain_ones(spark, cap, items):
    notes = {i: (json.dumps({"title": f"n{i}", "type": "t" * (i % 4)}), b, f"2024-0{i % 3 + 1}") for i, b in enumerate(BODIES)}
    edges = [(i, (i * k + 1) % 13, (i + k) % 4) for i in range(12) for k in (1, 2, 3, 5)] + [(0, 4, 0), (0, 4, 3), (4, 0, 1)]
    n = spark.createDataFrame([(i, *x, "kept") for i, x in notes.items()], "id long, frontmatter string, body string, updated string, target string").drop("target")
    e = spark.createDataFrame([(s, d, *KINDS[k][:2], at) for at, (s, d, k) in enumerate(edges)], "src long, dst long, edge_type string, confidence string, at long")
    for budget in (3, 40, 130):
        packed, near = packing.targets(n, budget, cap), packing.direct_candidates(e)
        made = packing.body_first(packed, near, n, items, cap) if items else packing.two_pass(packed, near, n, budget, cap)
        got = sorted((r.target, r.position, r.id, r.body) for r in packing.bodies(made, n, cap).collect())
        assert got == sorted(x for t in notes for x in plain_pack(notes, edges, t, budget, cap, items))


def test_no_notes_and_no_edges(spark):
    n = spark.createDataFrame([], "id long, frontmatter string, body string, updated string")
    e = spark.createDataFrame([], "src long, dst long, edge_type string, confidence string, at long")
    assert packing.two_pass(packing.targets(n, 10, 5), packing.direct_candidates(e), n, 10, 5).count() == 0


def test_traversed_candidates_rank_by_distance_and_priority(spark):
    e = spark.createDataFrame([(1, 2, "explicit_link", "high", 0), (2, 3, "tag_overlap", "medium", 1), (2, 4, "explicit_relation", "high", 2)], "src long, dst long, edge_type string, confidence string, at long")
    rows = packing.traversed_candidates(graph.neighbours(e, 1, 2, confidence="low"), e, 1).collect()
    assert {r.id: r.priority for r in rows} == {2: 11, 3: 22, 4: 20}


def test_cuts_never_split_a_character(spark):
    rows = spark.range(12).select(T.cut_bytes(F.lit("aé€😀b"), F.col("id")).alias("x")).collect()
    assert [r.x for r in rows] == ["", "a", "a", "aé", "aé", "aé", "aé€", "aé€", "aé€", "aé€", "aé€😀", "aé€😀b"]


def test_modes_of_search(spark):
    lane = lambda *ids: spark.createDataFrame([(i, 1.0 / (n + 1)) for n, i in enumerate(ids)], "id long, score double")
    lanes = {"bm25": lane(1, 2), "dense": lane(2, 3)}
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(retrieval.search(lanes, "keyword")) == {1, 2} and ids(retrieval.search(lanes, "semantic")) == {2, 3} and ids(retrieval.search(lanes)) == {1, 2, 3}
    assert ids(retrieval.search({"bm25": lanes["bm25"]})) == {1, 2}
    for bad in ({"mode": "fast", "lanes": lanes}, {"mode": "hybrid", "lanes": {"bm25": lanes["bm25"]}}):
        with pytest.raises(ValueError):
            retrieval.search(**bad)
    assert retrieval.ask({"bm25": lane()}, lane(1)).count() == 0


def test_registry_issues(spark):
    notes = [(1, "a", "open", {"owner": "x"}), (2, "a", "shut", {"by": "x"}), (3, "a", None, {"owner": ""}), (4, "zz", None, None), (5, "b", "any", None), (6, None, "", {})]
    n = spark.createDataFrame(notes, "id long, type string, status string, fields map<string,string>")
    types = spark.createDataFrame([("a", ["owner", "status"], ["open"]), ("b", [], [])], "type string, required array<string>, statuses array<string>")
    got = {(r.id, r.rule, r.field) for r in checks.registry_issues(n, types, {"owner": ["by"]}).collect()}
    assert got == {(2, "invalid_status", "status"), (3, "missing_required_field", "owner"), (3, "missing_required_field", "status"), (4, "unknown_type", "type"), (6, "unknown_type", "type")}
