"""Episodes, pushes, desks, redaction, exports and calibrations against plain versions."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.vectors import relevance
from quillspark.operators import calibration as K
from quillspark.operators import distill as D
from quillspark.operators import retrieval as R
from quillspark.sources import export as X

TURN = re.compile(r"^###[ \t]+(\d+)[ \t]+[—-][ \t]+(\S+)")


def plain_turns(path, content):
    """Line by line, with the state that a reader has."""
    name, section, open_, out = re.sub(r"\.md$", "", path.split("/")[-1]), "", None, []
    inside = seen = False

    def flush():
        nonlocal open_
        if open_:
            kind, number, ts, body = open_
            if kind == "user":
                body = ["" if x == ">" else x.removeprefix("> ") for x in body]
            out.append((kind, number, ts, "\n".join(body).strip()))
        open_ = None

    lines = content.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.removesuffix("\r")
        if line == "---":
            inside, seen = (not seen), True
            continue
        if inside:
            m = re.match(r"id:[ \t]*(\S+)", line)
            name = m[1] if m else name
            continue
        if line in (D.USER, D.ASSISTANT):
            flush()
            section = "user" if line == D.USER else "assistant"
        elif section:
            if m := TURN.match(line):
                flush()
                if int(m[1]) < 2**63:
                    open_ = (section, int(m[1]), m[2], [])
            elif open_:
                open_[3].append(line)
    flush()
    return [(name, *x) for x in out]


def test_turns_equal_reading_by_lines(spark):
    r = random.Random(4)
    bits = ["---", D.USER, D.ASSISTANT, "### 1 — t1", "### 22 - t2 more", "### 99999999999999999999 — x", "id: e1", "id:e2 x", "> said", ">", "> > deep", " text ", "", "###3 — no", f"{D.USER} ", "### 4 — t4"]
    texts = ["\n".join(r.choice(bits) for _ in range(r.choice((3, 8, 20)))) + r.choice(("", "\n", "\r\n")) for _ in range(300)]
    texts += ["", "---", "---\n", "---\n---", "a\n---\nid: z\n---\nb", "---\r\nid: q\r\n---\r\n" + f"{D.USER}\r\n### 1 — t\r\n> a\r\n---\r\n> b\r\n", f"{D.USER}\n### 1 — t\n" + "> long\n" * 30000]
    df = spark.createDataFrame([(f"d/p{i}.md", t) for i, t in enumerate(texts)] + [("null.md", None)], "path string, content string")
    got = {}
    for x in D.turns(df).orderBy("path", "at").collect():
        got.setdefault(x.path, []).append((x.episode, x.section, x.turn, x.ts, x.text))
    for i, t in enumerate(texts):
        assert got.get(f"d/p{i}.md", []) == plain_turns(f"d/p{i}.md", t), t[:300]
    assert "null.md" not in got and len(got) > 80


def test_pushes(spark):
    said = ["You DECIDE and full autonomy", "principle \t 7 holds", "remember the manifesto, principle 1", f"  {D.SUMMARY}: your call", "if you are sure, your call", "nothing", "", None, "principle 7"]
    got = sorted((x.i, x.rule, x.trigger) for x in D.pushes(spark.createDataFrame(list(enumerate(said)), "i int, text string")).collect())
    assert got == [(0, "authority-grant", "full autonomy"), (1, "manifesto-lens", "principle \t 7"), (2, "manifesto-lens", "remember the manifesto"), (4, "authority-grant", "your call"), (4, "evidence-gate", "if you are sure"), (8, "manifesto-lens", "principle 7")]
    files = spark.createDataFrame([("a.md", 5), ("b.md", None), ("c-part00000001.md", 1), ("c-part1.md", 1), ("d.md", 6000)], "path string, size long")
    assert sorted(x.path for x in D.signal(files).collect()) == ["b.md", "c-part00000001.md", "d.md"]


def test_desk(spark):
    e = lambda **f: "---\n" + "".join(f"{k}: {v}\n" for k, v in f.items()) + "---\n\n body \n"
    files = [("a.md", e(type="journal", id="a", date="2024-02-01")), ("b.MD", e(type='"Journal"', id="b", created="2024-03-01T10:00:00Z", title="'x: y'")), ("x/.git/c.md", e(type="journal")), ("d.txt", e(type="journal")), ("e.md", e(type="journal", distilled_to="arc")),
             ("f.md", e(type="note")), ("g.md", "no front"), ("h.md", e(type="journal", distilled_to="", date="null", created="'2024-01-05T10:00:00Z'")), ("i.md", None), ("j.md", "---\ntype: journal\n---\n" + "é" * 2000)]
    got = {x.path: tuple(x)[1:] for x in D.desk(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {"a.md": ("a", "", "2024-02-01", "body"), "b.MD": ("b", "x: y", "2024-03-01", "body"), "h.md": ("", "", "2024-01-05T10:00:00Z", "body"), "j.md": ("", "", "", "é" * 1200)}


def test_nearest_arcs_of_proposals(spark):
    r = random.Random(2)
    vec = lambda n=4: [r.gauss(0, 1) for _ in range(n)]
    arcs, own = [(i, vec()) for i in range(6)], [(i, vec()) for i in range(20)] + [(50, None), (51, vec(3)), (52, [0.0] * 4)]
    got = {x.id: [(a.arc_id, round(a.score, 9)) for a in x.nearest] for x in D.annotated(spark.createDataFrame(own, "id long, v array<double>"), spark.createDataFrame(arcs, "arc_id long, arc_v array<double>")).collect()}
    cos = lambda a, b: math.sumprod(a, b) / math.hypot(*a) / math.hypot(*b) if any(a) else 0.0
    for i, v in own:
        assert got[i] == ([(a, round(cos(v, w), 9)) for a, w in sorted(arcs, key=lambda x: (-cos(v, x[1]), x[0]))[:3]] if v and len(v) == 4 else []), i
    assert D.annotated(spark.createDataFrame(own, "id long, v array<double>"), spark.createDataFrame([], "arc_id long, arc_v array<double>")).filter("size(nearest) = 0").count() == len(own)


def test_nearest_by_blocks_equals_all_pairs(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillspark.functions.vectors import cosine
    from quillspark.operators import nearest, retrieval

    monkeypatch.setattr(nearest, "BLOCK", 7)
    r = random.Random(5)
    vec = lambda n=4: [float(r.randrange(-2, 3)) for _ in range(n)]
    odd = [None, [], [1.0], [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [-0.0, 0.0, 0.0, 0.0]]
    texts = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate([vec() for _ in range(40)] + odd + odd[:2])], "id string, v array<double>")
    arcs = spark.createDataFrame([(f"a{i}", v) for i, v in enumerate([vec() for _ in range(30)] + odd + [[1.0, 2.0, 1.0, 1.0]] * 20)], "arc_id string, arc_v array<double>")
    scored = texts.crossJoin(arcs).select("id", "arc_id", cosine(F.col("v"), F.col("arc_v")).alias("score"))
    for k, few in ((1, "texts"), (3, "arcs"), (60, "arcs")):
        want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "arc_id"))).filter(F.col("rank") <= k)
        assert sorted(map(str, retrieval.nearest(texts, arcs, k, few).collect())) == sorted(map(str, want.collect())), (k, few)
    assert not retrieval.nearest(texts, arcs.limit(0)).take(1)
    # pairs that can't be among the first k leave no task
    assert nearest.candidates(texts, arcs, 1, "arcs").count() < scored.count() / 3


def plain_redacted(data):
    try:
        x = json.loads(data)
    except (ValueError, TypeError):
        return None
    if not isinstance(x, dict):
        return None
    variants = x.get("variants")
    for v in variants.values() if isinstance(variants, dict) else ():
        if isinstance(v, dict) and isinstance(v.get("results"), list):
            v["results"] = [{k: y for k, y in row.items() if k not in X.IDENTIFYING} if isinstance(row, dict) else row for row in v["results"]]
    return x


def test_payloads_lose_their_notes_only(spark):
    one = {"note_id": "n", "path": "p", "rank": 1, "deep": {"path": "kept", "note_id": [1, None]}, "s": 'é"\n'}
    cases = [{}, {"variants": {"a": {"results": [one, 7, None, [one]], "path": "kept"}, "b": {"results": {"note_id": 1}}, "c": 4, "d": {}, "e": {"results": []}}, "path": "kept", "results": [one], "x": None}, {"variants": [one]}, {"variants": None}]
    rows = [json.dumps(c) for c in cases] + ["[1]", "7", "null", "{", "", None, '"s"']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, d string")
    for x in df.select("i", F.to_json(X.redacted(F.col("d"))).alias("r"), F.to_json(X.redacted(F.col("d"), X.FULL)).alias("full")).collect():
        assert (json.loads(x.r) if x.r else None) == plain_redacted(rows[x.i]), rows[x.i]
        assert (json.loads(x.full) if x.full else None) == (cases[x.i] if x.i < len(cases) else None)
    for tier in (X.OFF, "other"):
        with pytest.raises(ValueError):
            X.redacted(F.col("d"), tier)


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([("s1", "2024-02", None, "agent", "meta", None, "/r"), ("s0", "2024-01", "2024-03", None, None, "u", "/r")], "session_id string, started_at string, ended_at string, caller string, caller_meta string, user_session_id string, root string")
    e = spark.createDataFrame([("e", "s1", "search", "2024-02", "secret", "hybrid", None, '{"variants":{"a":{"results":[{"note_id":"n","rank":1}]}}}', "/r")], "event_id string, session_id string, event_type string, timestamp string, query_text string, query_mode string, primary_variant string, event_data string, root string")
    o = spark.createDataFrame([("o", "e", "n", "a", 2, "2024-02", "s1")], "outcome_id string, event_id string, note_id string, variant string, rank int, accessed_at string, session_id string")
    read = lambda tier: (X.write_records(X.records(s, e, o, tier, "now"), f"{tmp_path}/{tier}"), [json.loads(x) for f in sorted((tmp_path / tier).glob("part-*")) for x in f.read_text().splitlines()])[1]
    head = {"kind": "manifest", "exported_at": "now", "session_count": 2, "event_count": 1, "outcome_count": 1, "schema_version": 1}
    sessions = [{"kind": "session", "session_id": "s0", "started_at": "2024-01", "ended_at": "2024-03", "user_session_id": "u"}, {"kind": "session", "session_id": "s1", "started_at": "2024-02", "caller": "agent"}]
    event = {"kind": "event", "event_id": "e", "session_id": "s1", "event_type": "search", "timestamp": "2024-02", "query_mode": "hybrid"}
    outcome = {"kind": "outcome", "outcome_id": "o", "event_id": "e", "variant": "a", "rank": 2, "accessed_at": "2024-02", "session_id": "s1"}
    data = lambda row: {"variants": {"a": {"results": [row]}}}
    assert read(X.ANONYMOUS) == [{**head, "tier": "anonymous"}, *sessions, {**event, "data": data({"rank": 1})}, outcome]
    full = [{**head, "tier": "full"}, {**sessions[0], "root": "/r"}, {**sessions[1], "root": "/r", "caller_meta": "meta"}, {**event, "root": "/r", "query_text": "secret", "data": data({"note_id": "n", "rank": 1})}, {**outcome, "note_id": "n"}]
    assert read(X.FULL) == full
    with pytest.raises(ValueError):
        X.records(s, e, o, X.OFF, "now")


def test_rollup_of_nothing(spark):
    t = lambda schema: spark.createDataFrame([], schema)
    x = t("x int")
    row = X.rollup(t("id int, type string"), x, x, t("v array<double>"), x, x, x, t("variant string, events long, outcomes long, hit_5 double, hit_10 double, mrr double"), "f", X.FULL, "now").first()
    assert row.type_distribution == {} and row.variant_stats == {} and (row.note_count, row.embedding_count, row.embedding_dims, row.event_count) == (0, 0, 0, 0)


def test_calibrations(spark):
    r = random.Random(1)
    vec = lambda n=3: [r.gauss(0, 1) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    probes = spark.createDataFrame([(vec(),), (vec(),)], "p array<double>")
    assert K.measured(frame([]), probes, "k", "t").count() == 0
    assert K.measured(frame([(1, vec()), (2, vec(4))]), probes, "k", "t").count() == 0
    one = K.measured(frame([(1, [-x for x in probes.first().p])]), probes.limit(1), "k", "t", "e").first()
    assert (one.notes, one.noise_floor, one.mu, one.sigma, one.pairs, one.embedder) == (1, 0.0, 0.0, 0.0, 0, "e")
    many = frame([(i, vec()) for i in range(40)])
    got = K.measured(many, probes, "k", "t").first()
    assert (got.dims, got.notes, got.pairs, got.probes) == (3, 40, 780, 2) and 0 < got.noise_floor <= 1

    snaps = spark.createDataFrame([("a", "2024-01", 1, 30, 100, 0.5, 0.58, 0.2, 1), ("a", "2023-12", 9, 1, 1, 0.9, 0.1, 0.1, 1), ("b", "2024-01", 1, 29, 100, 0.5, 0.9, 0.1, 1), ("c", "2024-01", 1, 30, 100, 0.5, 0.5, 0.05, 0), ("c", "2024-01", 2, 30, 99, 0.5, 0.5, 0.05, 0)], "key string, created_at string, seq int, notes long, pairs long, noise_floor double, mu double, sigma double, probes_version int")
    newest = K.latest(snaps)
    found = {x.key: tuple(x)[1:] for x in K.resolved(spark.createDataFrame([("a", 8), ("b", 1024), ("c", 384), ("d", None)], "key string, dims int"), newest).collect()}
    assert found == {"a": (0.5, 0.12, True, True), "b": (0.45, 0.073, False, False), "c": (0.0, 0.03, False, False), "d": (0.0, 0.03, False, False)}
    again = K.due(spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("c", 0, None), ("d", None, None), ("e", 0, 0)], "key string, embedded int, deleted int"), newest)
    assert sorted(x.key for x in again.collect()) == ["b", "c", "d", "e"]


def test_relevance_at_its_edges(spark):
    rows = [(0.25, 0.3, 0.1), (0.2500001, 0.3, 0.1), (0.5, 0.25, 0.25), (0.9, 0.3, 0.1), (0.5, 0.3, 0.0), (float("nan"), 0.3, 0.1)]
    got = spark.createDataFrame(rows, "top double, noise double, sigma double").select(relevance(F.col("top"), F.col("noise"), F.col("sigma"), 0.45).alias("x")).collect()
    assert [x.x.label for x in got] == ["no_match", "weak", "weak", "strong", "no_match", "no_match"] and got[4].x.z == got[5].x.z == 0


def test_activation_lane(spark):
    act = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, 0.5), (9, 7.0)], "id int, activation double")
    notes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, type string")
    lane = lambda *k: {x.id: x.score for x in R.activation_lane(act, notes, *k).collect()}
    assert lane() == {1: 1.0, 2: 0.0, 3: 0.5} and lane("a") == {1: 1.0, 2: 0.0} and lane("b") == {3: 1.0} and lane("c") == {}
    d = R.activation_lane(act, notes)
    assert list(R.assembled(d, d, dense=None, sparse=d)) == ["bm25"] and list(R.assembled(d, d, dense=d, sparse=None, late=d)) == ["bm25", "dense", "late", "activation"]
