"""The persisted index: increments against rebuilds, duplicates, moves, new ids, failed runs."""

import hashlib
import random

import pytest

from quillspark.sources import index
from quillspark.sources.index import NoteIndex, classified, settled

@pytest.fixture(autouse=True)
def few_tasks(spark):
    """A handful of rows need no more than one task for each step."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


FILES = "path string, mtime long, content string, hash string"


def frame(spark, files):
    """files: path -> (mtime, content)"""
    return spark.createDataFrame([(p, m, c, hashlib.sha256(c.encode()).hexdigest()) for p, (m, c) in sorted(files.items())], FILES)


def note(id_, body="", **more):
    head = "".join(f"{k}: {v}\n" for k, v in {"id": id_, "type": "concept", **more}.items() if v)
    return f"---\n{head}---\n{body}\n"


def state(ix):
    out = {}
    for name in index.TABLES:
        rows = ix.table(name).collect()
        out[name] = sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in rows), key=str)
    return out


def edges(ix):
    return sorted((r.src, r.raw, r.edge_type, r.dst) for r in ix.edges().collect()) if ix.versions() else []


def test_classified_and_settled(spark):
    catalog = spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", 1, "y"), ("c", "1", 1, "z"), ("d", "1", 1, "w"), ("e", "1", 1, "v")], "path string, hash string, mtime long, id string")
    files = spark.createDataFrame([("a", 1, "", "9"), ("b", 2, "", "1"), ("c", 2, "", "2"), ("m", 1, "", "3"), ("n", 1, "", "4"), ("o", 1, "", "5"), ("p", 1, "", "6"), (None, 1, "", "6"), ("p", 0, "", "7")], FILES)
    found = classified(files, catalog)
    assert {(r.path, r.change) for r in found.collect()} == {("a", "same"), ("b", "touched"), ("c", "changed"), ("d", "deleted"), ("e", "deleted"), ("m", "added"), ("n", "added"), ("o", "added"), ("p", "added")}
    parsed = spark.createDataFrame([("c", "zz"), ("m", "w"), ("n", "w"), ("o", "x"), ("p", "z")], "path string, id string")
    assert {tuple(r) for r in settled(found, parsed).collect()} == {
        ("b", "touch", "y", "y", None),
        ("c", "store", "zz", "z", None),
        ("d", "move", "w", "w", "m"),
        ("e", "delete", "v", "v", None),
        ("m", "store", "w", None, None),
        ("n", "duplicate", "w", None, "m"),
        ("o", "duplicate", "x", None, "a"),
        ("p", "duplicate", "z", None, "c"),  # until the next run, when c has given it up
    }


def test_increments_equal_a_rebuild(spark, tmp_path):
    r, files, now = random.Random(8), {}, 0
    ix = NoteIndex(spark, f"{tmp_path}/one", buckets=4)
    for step in range(3):
        for _ in range(12 if step == 0 else 6):
            now += 1
            k = r.randrange(15)
            body = f"# Head {now}\nsee [[n{r.randrange(15)}]] ![[t{r.randrange(15)}]] text ^b{now}"
            files[f"d{k % 3}/f{k}.md"] = (now, note(f"n{k}", body, title=f"t{k}", tags=f"[a, g{k % 4}]", aliases=f"[al{k}]"))
        for p in r.sample(sorted(files), 2):
            now += 1
            if step == 1:
                files[p] = (now, files[p][1])  # touched only
            elif step == 2:
                del files[p]
        files["plain.md"] = (now, f"no frontmatter {step}")
        ix.update(frame(spark, files))
    other = NoteIndex(spark, f"{tmp_path}/two", buckets=4)
    other.update(frame(spark, files))
    assert state(ix) == state(other) and edges(ix) == edges(other)
    assert len(state(ix)["notes"]) == len(files) and any(x[3] is not None for x in edges(ix))
    before = state(ix)
    assert ix.update(frame(spark, files)) == {} and ix.versions()[-1] == 3  # nothing to do, no new version
    ix.rebuild(frame(spark, files))
    assert state(ix) == before and NoteIndex(spark, f"{tmp_path}/one", buckets=99).buckets == 4
    assert ix.vacuum(keep=1) > 0 and state(ix) == before and ix.versions() == [4]


def test_duplicates_moves_and_history(spark, tmp_path):
    ix = NoteIndex(spark, str(tmp_path), buckets=3)
    files = {"a.md": (1, note("x", "one")), "b.md": (1, note("x", "two")), "c.md": (1, "bare")}
    assert ix.update(frame(spark, files)) == {"store": 2, "duplicate": 1}
    stamp = "timestamp'2024-01-01 00:00:00'"
    ix.record(spark.sql(f"select * from values ('x', {stamp}, 'agent'), ('_path:c.md', {stamp}, 'hook'), ('unknown', {stamp}, 'agent') as t(id, ts, caller)"))
    assert sorted(r.id for r in ix.table("accesses").collect()) == ["_path:c.md", "x"]
    # c declares an id and keeps its history; a moves, with x; b is a duplicate still
    files = {"z/a.md": (2, note("x", "one")), "b.md": (1, note("x", "two")), "c.md": (2, note("c"))}
    assert ix.update(frame(spark, files)) == {"store": 2, "move": 1, "duplicate": 1}
    held = {r.id: r.path for r in ix.table("notes").collect()}
    assert held == {"x": "b.md", "c": "c.md"} and sorted(r.id for r in ix.table("accesses").collect()) == ["c", "x"]
    # the holder goes, and the one that waited gets the id
    files = {"z/a.md": (2, note("x", "one")), "c.md": (2, note("c"))}
    ix.update(frame(spark, files))
    assert {r.id: r.path for r in ix.table("notes").collect()} == {"x": "z/a.md", "c": "c.md"}
    ix.update(frame(spark, {"c.md": (2, note("c"))}))
    assert [r.id for r in ix.table("notes").collect()] == ["c"] == [r.id for r in ix.table("accesses").collect()]
    ix.update(frame(spark, {"c.md": (9, note("c"))}))  # only its time
    assert [(r.path, r.mtime) for r in ix.table("catalog").collect()] == [("c.md", 9)]
    ix.update(frame(spark, {}))
    assert all(not rows for rows in state(ix).values())


def test_a_failed_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    ix = NoteIndex(spark, str(tmp_path), buckets=2)
    ix.update(frame(spark, {"a.md": (1, note("x", "[[y]]"))}))
    before = state(ix)

    def broken(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(index.M, "links", broken)
        with pytest.raises(OSError):
            ix.update(frame(spark, {"a.md": (2, note("x", "other")), "b.md": (1, note("y"))}))
    assert state(ix) == before and edges(ix) == [("x", "y", "explicit_link", None)]


def test_of_two_runs_at_once_the_second_fails(spark, tmp_path, monkeypatch):
    ix = NoteIndex(spark, str(tmp_path), buckets=2)
    ix.update(frame(spark, {"a.md": (1, note("x"))}))
    old = ix._manifest()
    ix.update(frame(spark, {"a.md": (2, note("y"))}))
    old["version"] += 1
    with pytest.raises(RuntimeError):
        ix._commit(old)
    assert [r.id for r in ix.table("notes").collect()] == ["y"]
