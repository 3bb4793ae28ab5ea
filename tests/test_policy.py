"""Decisions on changes, plans' shape, new notes and confined paths against plain versions."""

import itertools
import posixpath

import pytest
from pyspark.sql import functions as F

from quillspark.operators import policy as P

STATE = "i int, access string, target string, repo boolean, clean boolean, detached boolean, merging boolean, rebasing boolean, staged array<string>, unstaged array<string>"


def plain(row, overrides):
    _, access, target, repo, clean, detached, merging, rebasing, staged, unstaged = row
    if access not in P.ACCESS:
        return "refuse", [("invalid_operation", "refuse")]
    own = target in [*(staged or []), *(unstaged or [])]
    holds = {"dirty_unrelated": repo and not clean and target and not own, "dirty_target": repo and target and own, "detached_head": repo and detached, "merge_in_progress": merging or rebasing, "no_repo": not repo}
    out = []
    for rule, each in P.RULES.items():
        if holds[rule]:
            d = each[P.ACCESS.index(access)]
            if rule in overrides and access.startswith("write"):
                d = "refuse" if access == "write_commit" and rule in P.GUARDED else overrides[rule]
            out.append((rule, d))
    return max([d for _, d in out] or ["allow"], key=P.DECISIONS.index), out


def test_decisions(spark):
    flags = itertools.product((*P.ACCESS, "x", None), ("a.md", "", None), (True, False, None), (True, False), (True, None), (True, False), ([], ["a.md"], None))
    rows = [(i, a, t, r, c, d, m, i % 5 == 0, s, ["b.md", "a.md"] if i % 7 == 0 else None) for i, (a, t, r, c, d, m, s) in enumerate(flags)]
    df = spark.createDataFrame(rows, STATE)
    for overrides in ({}, {"no_repo": "allow", "dirty_target": "warn", "detached_head": "allow"}):
        got = {x.i: (x.decision, [tuple(y) for y in x.reasons]) for x in P.decided(df, overrides).collect()}
        assert all(got[r[0]] == plain(r, overrides) for r in rows)
    for bad in ({"other": "warn"}, {"no_repo": "never"}):
        with pytest.raises(ValueError):
            P.decided(df, bad)


def test_shape_of_plans(spark):
    plans = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, None), (None, 1)], "plan int, version int")
    schema = "plan int, at int, op string, target string, key string, value string, fields map<string,string>, section_key string, template string, path string, type string, frontmatter map<string,string>"
    n = [None] * 9
    ops = [(1, 0, "frontmatter_set", *n), (1, 1, "frontmatter_unset", "t", "k", *n[2:]), (1, 2, "frontmatter_merge", "t", None, None, {}, *n[4:]), (1, 3, "generated_region_render", "", None, None, None, "s", "x", None, None, None),
           (1, 4, "note_create", None, None, None, None, None, None, "p", "odd", {}), (1, 5, "note_create", None, None, None, None, None, None, "p", "t", None), (1, 6, "what", *n), (1, 7, None, *n), (1, 8, "frontmatter_set", "t", "k", "", *n[3:]), (2, 0, "what", *n)]
    got = sorted(map(tuple, P.plan_issues(plans, spark.createDataFrame(ops, schema), spark.createDataFrame([("t",)], "type string")).collect()), key=str)
    want = [(1, 0, "missing_field", f) for f in ("target", "key", "value")] + [(1, 2, "missing_field", "fields"), (1, 3, "missing_field", "target"), (1, 4, "unknown_type", "type"), (1, 5, "missing_field", "frontmatter"), (1, 6, "unknown_operation", "op"), (1, 7, "unknown_operation", "op"), (2, None, "unsupported_version", None), (3, None, "empty_plan", None), (4, None, "unsupported_version", None)]
    assert got == sorted(want, key=str)


def test_new_notes(spark):
    rows = [("a/b.md", 1, "t", {"z": "1", "id": "own", "a": None}, "text"), ("a/b.md", 2, "t", None, ""), ("old.md", 3, "t", None, ""), ("c d.md", 4, "t", {"id": "", "type": "other"}, "x\n"), ("../x.md", 5, "t", None, None)]
    got = {x.at: (x.id, x.content, x.error) for x in P.created(spark.createDataFrame(rows, "path string, at int, type string, fields map<string,string>, body string"), spark.createDataFrame([("old.md",)], "path string")).collect()}
    assert got == {1: ("own", "---\na: null\nid: own\ntype: t\nz: 1\n---\n\ntext\n", None), 2: (None, None, "path_exists"), 3: (None, None, "path_exists"), 4: ("t-c d", "---\nid: t-c d\ntype: t\n---\n\nx\n", None), 5: (None, None, "escapes")}


def test_paths_and_collections(spark):
    parts = ["", ".", "..", "a", "b"]
    paths = ["/".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)]
    got = {x.p: x.ok for x in spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", P.confined(F.col("p")).alias("ok")).collect()}

    def stays(p):
        steps = p.split("/")
        return p != "" and not p.startswith("/") and all(not posixpath.normpath("/".join(steps[: i + 1]) or ".").startswith("..") for i in range(len(steps)))

    assert all(got[p] == stays(p) for p in paths) and got[None] is False
    files = ["x/.c/f", "x/y/.c/f", "z/w/.c", "a/b/c/d/.c/f", "a/b/c/d2/e/.c/f", "n.md", "q/.cc/f"]
    roots = lambda more: {x.root for x in P.collections(spark.createDataFrame([(p,) for p in files + more] + [(None,)], "path string"), ".c").collect()}
    assert roots([]) == {"x", "z/w", "a/b/c/d"} and roots([".c/f"]) == {""}


def test_operations_do_not_meet_by_their_type(spark):
    ops = spark.range(100).selectExpr("id % 9 AS plan", "id AS at", "'note_create' AS op", "'t' AS target", "'k' AS key", "'v' AS value", "map('a', 'b') AS fields", "'s' AS section_key", "'m' AS template", "'p' AS path", "'few' AS type", "map('a', 'b') AS frontmatter")
    found = P.plan_issues(spark.range(9).selectExpr("id AS plan", "1 AS version"), ops, spark.range(1).selectExpr("'other' AS type"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of unknown or great size
    try:
        assert "hashpartitioning(type" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("code = 'unknown_type'").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
