import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.functions.vectors import edge_priority
from quillspark.operators import analytics as A
from quillspark.operators import checks as C
from quillspark.operators import graph as G
from quillspark.operators import memory as M
from quillspark.operators import mutation
from quillspark.operators import retrieval as R
from quillspark.sources import markdown


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fusion_averages_over_the_lanes_that_found_a_note(spark):
    lanes = {"a": spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double"), "b": spark.createDataFrame([(2, 5.0)], "id long, score double")}
    got = {r.id: r.score for r in R.fuse(lanes).collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx((1 / 62 + 1 / 61) / 2)}


def test_cosine_and_maxsim_edges(spark):
    f = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(f(1, 0), f(0, 0))) == 0 and one(spark, V.cosine(f(1), f(1, 2))) == 0
    assert one(spark, V.maxsim(F.array(f(1.0, 0.0), f(0.0, -2.0)), F.array(f(1.0, 0.0), f(0.0, 1.0)))) == 1.0


def test_bm25_needs_every_word_and_pages_are_normalised(spark):
    notes = spark.createDataFrame([(1, "red fox"), (2, "red red fox den"), (3, "red"), (4, None)], "id long, text string")
    got = R.page(R.bm25(notes, 'Red "fox"'), 10).collect()
    assert {r.id for r in got} == {1, 2} and {r.score for r in got} <= {0.0, 1.0}


def test_rerank_puts_inactive_notes_past_the_last(spark):
    c = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    a = spark.createDataFrame([(1, -1.0), (2, 2.0)], "id long, activation double")
    got = {r.id: r.final for r in R.rerank(c, a).collect()}
    assert got[1] == pytest.approx(0.9 / 61 + 0.1 / 64) and got[2] == pytest.approx(0.9 / 62 + 0.1 / 61)


def test_session_goes_on_at_exactly_the_gap(spark):
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:30:00"), (3, 1, "2024-01-01 01:00:01")], "event_id long, user long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in A.session_spans(e).collect()) == [1, 2]


def test_use_at_exactly_the_window_counts(spark):
    t = lambda d: d.withColumn("ts", F.to_timestamp("ts"))
    i = t(spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (2, "a", "2024-01-01 01:00:00"), (3, None, "2024-01-01 01:00:00")], "inj_id long, key string, ts string"))
    u = t(spark.createDataFrame([("a", "2024-01-01 00:40:00")], "key string, ts string"))
    assert {r.inj_id: r.consumed for r in A.consumed(i, u).collect()} == {1: True, 2: False, 3: False}


def test_greedy_pack_skips_and_prefix_pack_stops(spark):
    items = spark.createDataFrame([("k", 0, 5), ("k", 1, 9), ("k", 2, 4)], "key string, position long, tokens long")
    assert [r.position for r in M.greedy_pack(items, 10).orderBy("position").collect()] == [0, 2]
    assert [r.position for r in M.prefix_pack(items, 10).collect()] == [0]


def test_kendall_without_two_common_ids_is_null(spark):
    r = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 1), ("b", 1, 1, 1)], "key string, id long, rank_a int, rank_b int")
    assert {x.key: x.tau for x in A.kendall(r).collect()} == {"a": -1.0, "b": None}


def test_jaccard_of_nothing_is_one(spark):
    none = F.array().cast("array<int>")
    assert one(spark, A.jaccard_at(none, none, 5)) == 1.0


def test_interval_merge_and_active_time(spark):
    t = lambda d, *c: d.withColumns({x: F.to_timestamp(x) for x in c})
    w = t(spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 02:00:00"), (1, "2024-01-01 01:00:00", "2024-01-01 03:00:00")], "key long, start string, end string"), "start", "end")
    s = t(spark.createDataFrame([(1, 7, "2024-01-01 01:00:00")], "key long, id long, ts string"), "ts")
    assert A.active_hours(w, s, "2024-01-01 05:00:00", 0.5).first()["hours"] == 3.0


def test_payload_ignores_malformed_rows(spark):
    rows = spark.createDataFrame([(1, '{"variants":{"v":{"results":[{"note_id":"n","rank":2}]}}}'), (2, "{"), (3, None)], "event_id long, event_data string")
    assert [tuple(r) for r in A.payload(rows).collect()] == [(1, "v", "n", 2)]


def test_resolution_takes_the_first_tier(spark):
    names = spark.createDataFrame([("a", "Red Fox"), ("b", "red-fox"), ("c", None)], "id string, title string")
    aliases, paths = spark.createDataFrame([("b", "Reynard"), ("c", "Old_Fox")], "id string, alias string"), spark.createDataFrame([("c", "x/c.md")], "id string, path string")
    asked = ("red fox", "b", "Reynard", "reynard", "old-fox", "x/c.md", "c.md", "Red Fox", "red_fox", None)
    got = G.resolve(spark.createDataFrame([(x,) for x in asked], "input string"), names, aliases, paths).collect()
    want = {("red fox", "normalized", "a", 1), ("b", "id", "b", 1), ("Reynard", "alias", "b", 1), ("reynard", "normalized", "b", 1), ("old-fox", "normalized", "c", 1), ("x/c.md", "path", "c", 1), ("Red Fox", "title", "a", 1), ("red_fox", "normalized", "a", 2)}
    assert {(r.input, r.tier, r.id, r.n) for r in got} == want


def test_neighbours_are_undirected(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    assert {(r.id, r.distance) for r in G.neighbours(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_plain_text_of_markdown(spark):
    body = "~~~\ncode\n```\nkept *it* and _so_ ~~old~~ `c`\n\n***\n> quote  two ^block-1\n<b>bold</b> ![[e.png]] [t](u) %%stays%%\n- item\n```\nopen"
    assert one(spark, T.strip_markdown(F.lit(body))) == "kept it and so old c\n\nquote two\nbold t %%stays%%\n- item"


def test_edge_priorities(spark):
    for kind, confidence, want in (("explicit_relation", "low", 0), ("explicit_link", "low", 1), ("explicit_embed", None, 1), ("tag_overlap", "high", 3), ("tag_overlap", "medium", 2), ("alias_mention", None, 3)):
        assert one(spark, edge_priority(F.lit(kind), F.lit(confidence))) == want


def test_frontmatter_ends_on_a_line_of_its_own(spark):
    assert mutation.mutate("---\ntitle: a---\nzeta: 1\ntags: [x]\ncreated: 2\n---\nbody", {"status": ["new"]})[0] == "---\nstatus: new\ntitle: a---\ntags:\n  - x\ncreated: 2\nzeta: 1\n---\nbody"
    assert one(spark, markdown.split_frontmatter(F.lit("---\ntitle: a---\n---\nbody"))[1]) == "body"


def test_text_functions(spark):
    assert one(spark, T.estimate_tokens(F.lit("éé1"))) == 2
    assert one(spark, T.slugify(F.lit("A b-C, ü!"))) == "a-b-c-ü"
    assert one(spark, T.snake_case(F.lit("camelCaseX"))) == "camel_case_x"
    assert one(spark, T.strip_markdown(F.lit("# T\n```\nx\n```\nsee [[a|B]] and **c**"))).split() == ["T", "see", "B", "and", "c"]
    assert one(spark, T.excerpt(F.lit("# Head\n\nOne two. Three four. Five."), 5)) == "One two. Three four."


def test_relevance_labels(spark):
    x = one(spark, V.relevance(F.lit(0.5), F.lit(0.3), F.lit(0.05), 0.3))
    assert x.label == "strong" and one(spark, V.clamp_sigma(F.lit(float("nan")))) == 0.03
    assert one(spark, V.meets_confidence(F.lit("odd"), "low")) is False


def test_reconcile_and_rules(spark):
    a, b = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, hash string"), spark.createDataFrame([("q", "3"), ("r", "4")], "path string, hash string")
    assert {tuple(r) for r in C.reconcile(a, b).collect()} == {("p", "unindexed"), ("q", "drifted"), ("r", "orphaned")}
    rows = spark.createDataFrame([(1, None), (2, "x")], "id long, status string")
    assert [tuple(r) for r in C.issues(rows, {"none": ("error", F.col("status").isNull())}).collect()] == [(1, "none", "error")]


def test_markdown_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/n.md").write_text("---\nid: n1\ntype: concept\ntags: [x, y]\nrelated_ids:\n  - n2\n---\n# Title\nsee [[n2#h|that]] `[[code]]`\n")
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/c.md").write_text("no")
    files = markdown.scan(spark, str(tmp_path), ("skip",))
    notes = markdown.notes(files)
    got = {r.path: r for r in notes.collect()}
    assert got["a/n.md"].id == "n1" and got["a/n.md"].tags == ["x", "y"] and got["b.md"].id == "_path:b.md"
    assert {(r.src, r.raw, r.edge_type) for r in markdown.links(notes).collect()} == {("n1", "n2", "explicit_link"), ("n1", "n2", "explicit_relation")}
    catalog = files.filter("path = 'b.md'").select("path", "hash", "mtime")
    assert [tuple(r) for r in markdown.changes(files, catalog).collect()] == [("a/n.md", "added")]


def test_mutations():
    new, diff = mutation.mutate("---\ntitle: a\nid: x\n---\nbody\n", {"status": ["done"]}, ("title",))
    assert new == "---\nid: x\nstatus: done\n---\nbody\n" and "+status: done" in diff
    region = f"<!-- region:k {hashlib.sha256(b'old').hexdigest()} -->\nold<!-- endregion:k -->"
    assert "new<!--" in mutation.replace_region(region, "k", "new")
    with pytest.raises(ValueError):
        mutation.replace_region(region.replace("\nold", "\nhand"), "k", "new")
    with pytest.raises(KeyError):
        mutation.apply_plan({"a": ""}, [{"path": "b"}])


def test_streamed_sessions_match_batch(spark, tmp_path):
    from quillspark.streaming.sessions import user_sessions

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-02 12:00:00")]
    spark.createDataFrame(rows, "user long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in"))
    q = user_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.user, r.n) for r in spark.table("sess").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_pair_spread_strides_over_the_pairs_of_all_vectors(spark):
    r = random.Random(2)
    vectors = [(3 * i, [r.gauss(i > 200, 1) for _ in range(4)]) for i in range(230)]
    shuffled = spark.createDataFrame(r.sample(vectors, len(vectors)), "id long, v array<double>")
    u = np.array([v for _, v in vectors])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    every = np.array([u[i] @ u[j] for i in range(len(u)) for j in range(i + 1, len(u))])
    for most in (200_000, 1000, 999):
        want, got = every[:: -(-len(every) // most)], R.pair_spread(shuffled, most).first()
        assert got.n_pairs == len(want) and np.allclose([got.mu, got.sigma], [want.mean(), want.std()])


def test_tag_overlap_equals_all_pairs(spark):
    import itertools
    import math
    import random

    rng = random.Random(5)
    rows = [(i, f"t{int(rng.random() ** 2 * 25)}") for i in range(60) for _ in range(rng.randrange(9))] + [(i, "everywhere") for i in range(60)] + [(None, "t1"), (3, None)]
    tags = spark.createDataFrame([*rows, *rows[:9]], "id long, tag string")
    own = {}
    for i, t in rows:
        if i is not None and t is not None:
            own.setdefault(i, set()).add(t)
    weight = {t: math.log(len(own) / sum(t in x for x in own.values())) for x in own.values() for t in x}
    for threshold in (0.0, 1.0, 3.5, 6.0):
        want = {(a, b): sum(weight[t] for t in own[a] & own[b]) for a, b in itertools.combinations(sorted(own), 2) if own[a] & own[b]}
        want = {k: (round(w, 6), len(own[k[0]] & own[k[1]])) for k, w in want.items() if w >= threshold}
        assert {(r.a, r.b): (round(r.weight, 6), r.n_tags) for r in G.tag_overlap(tags, threshold).collect()} == want
    assert G.tag_overlap(tags.limit(0), 1.0).count() == 0
