import pytest

from quillspark.functions import codecs
from quillspark.operators import store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_vectors_come_back_from_bytes(spark):
    df = spark.createDataFrame([([1.0, -2.5], {3: 0.5, 1: 2.0}, [[1.0, 2.0], [3.0, 4.0]]), (None, None, None), ([], {}, [])], "v array<float>, s map<int,float>, m array<array<float>>")
    blobs = df.select(codecs.encode_dense("v").alias("v"), codecs.encode_sparse("s").alias("s"), codecs.encode_multi("m").alias("m"))
    first = blobs.first()
    assert bytes(first.v).hex() == "0000803f000020c0" and bytes(first.s).hex() == "010000000000004003000000" + "0000003f" and bytes(first.m)[:4] == b"\x02\0\0\0"
    back = blobs.select(codecs.decode_dense("v").alias("v"), codecs.decode_sparse("s").alias("s"), codecs.decode_multi("m").alias("m")).collect()
    assert tuple(back[0]) == ([1.0, -2.5], {1: 2.0, 3: 0.5}, [[1.0, 2.0], [3.0, 4.0]]) and tuple(back[1]) == tuple(back[2]) == (None, {}, None)
    with pytest.raises(Exception, match="whole items"):
        spark.createDataFrame([(b"abc",)], "b binary").select(codecs.decode_dense("b")).collect()


def test_changes_and_deletes_reach_every_table(spark):
    notes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    assert rows(store.upsert(notes, spark.createDataFrame([("b", 9), ("d", 4)], "id string, x int"))) == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]
    tags = spark.createDataFrame([("a", "t"), ("b", "u")], "id string, tag string")
    assert rows(store.replace_children(tags, notes.filter("id <> 'b'"), spark.createDataFrame([("c", "v")], "id string, tag string"))) == [("b", "u"), ("c", "v")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", None)], "src string, dst string")
    left = store.delete_notes(notes, links, spark.createDataFrame([("b",)], "id string"), tags=tags)
    assert rows(left["notes"]) == [("a", 1), ("c", 3)] and rows(left["tags"]) == [("a", "t")] and rows(left["links"]) == [("a", None), ("c", "a")]
    files = lambda *x: spark.createDataFrame(x, "path string, hash string")
    assert rows(store.changes(files(("p", "1"), ("q", "1"), ("r", "1")), files(("p", "1"), ("q", "2"), ("s", "1")))) == [("q", "changed"), ("r", "removed"), ("s", "added")]


def test_a_run_is_held_against_its_snapshot(spark):
    metric = lambda *x: spark.createDataFrame(x, "query string, metric string, value double")
    old, new = metric(("a", "hit", 1.0), ("a", "rr", 0.5), ("b", "rr", 1.0)), metric(("a", "hit", 0.99), ("a", "rr", 0.4))
    assert rows(store.regressions(old, new)) == [("a", "rr", 0.5, 0.4), ("b", "rr", 1.0, None)]
    runs = spark.createDataFrame([(True, 1.0), (False, 0.0)], "hit boolean, rr double")
    assert rows(store.run_means(runs)) == [(0.5, 0.5, 2)] and rows(store.run_means(runs.limit(0))) == [(0.0, 0.0, 0)]
