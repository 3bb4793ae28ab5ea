"""Spelling variants, interval overlaps and byte-pair encoding against plain versions."""

import datetime
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute import allen, spellings
from tokenizers import Tokenizer

from quillspark.llm import bpe, interval_join, queries, spelling

WORD_COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y", "z") for d, t in rows], "doc_id long, text string, word string, n long, near string, form string")


@pytest.fixture(scope="module")
def prose():
    r = random.Random(4)
    stems = ["letter", "garden", "straße", "ÉCLAIR", "window", "aaaaaa", "banana", "orchard", "o" * 400]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = r.choice(stems)
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("aeßo") + w[k:], w[:k] + r.choice("aeo") + w[k + 1 :], w + w[-1], w.upper()))
            words.append(w)
        rows.append((i, r.choice((" ", ", ", "1")).join(words)))
    rows.append((200, "marble " * 150 + "marbles " * 30 + "marblest " * 6))
    return [*rows, rows[3], (3, None), (None, rows[5][1]), (7, ""), (8, "short wo rds 123"), (9, "x" * 30_000)] + [(20 + i, "y" * 5000 + " " + "y" * 5001) for i in range(6)]


def test_spelling_variants(spark, prose):
    want = sorted(spellings(prose), key=str)
    assert got(spelling.variants(docs_of(spark, prose), n_bits=1 << 20), *WORD_COLUMNS) == want
    assert len(want) > 50 and any(x[1] and x[1] != x[2] for x in want) and any(len(x[0]) == 5000 for x in want)
    # a bit set that is full lets every candidate through
    assert got(spelling.variants(docs_of(spark, prose[:20]), n_bits=64), *WORD_COLUMNS) == sorted(spellings(prose[:20]), key=str)


def test_spelling_of_empty_tables(spark):
    assert spelling.variants(docs_of(spark, [])).collect() == [] == spelling.variants(docs_of(spark, [(1, None), (2, "few words")])).collect()


def test_each_neighbour_comes_once():
    for word in ("aab", "abab", "ccc", "x", "abcabc"):
        every = [x for _, x in spelling.Neighbours("abc", None).of([word])]
        cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
        other = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc"} - {word}
        assert sorted(every) == sorted(cut | other | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abc"})


def test_words_counted_with_flushes():
    texts = [(i, f"letter garden number{'abcdefghij'[i]}") for i in range(10)]
    parts = list(spelling.counted(texts, flush=3))
    assert len(parts) > 3 and sum(p["letter"] for p in parts) + sum(p["garden"] for p in parts) >= 19


def times(rows, at):
    zero = datetime.datetime(1970, 1, 1)
    return [tuple(zero + datetime.timedelta(microseconds=x) if k == at and x is not None else x for k, x in enumerate(r)) for r in rows]


def shop(spark, sales, lines, clicks):
    made = spark.createDataFrame(times(sales, 3), "sale_id long, client_id long, status string, sold_at timestamp_ntz").selectExpr("*", "1 AS n", "2 AS s", "3 AS bucket", "4 AS crc")
    shipped = spark.createDataFrame(times(lines, 1), "sale_id long, shipped_at timestamp_ntz").selectExpr("*", "1 AS client_id", "2 AS first")
    seen = spark.createDataFrame(times(clicks, 0), "ts timestamp_ntz, client_id long, kind string").selectExpr("*", "1 AS piece", "2 AS day", "3 AS run", "4 AS e")
    return made, shipped, seen


OVERLAP_COLUMNS = ("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_interval_overlaps(spark, seed, zone):
    r, hour, day = random.Random(seed), 3_600_000_000, 86_400_000_000
    start = r.choice((-3, 0, 19_000)) * day
    when = lambda days: start + r.randrange(days * day) // r.choice((1, hour)) * r.choice((1, hour)) % (days * day)
    sales = [(i, r.choice((None, 1, 1, 2, 3, 4)), r.choice(("open", "done", None)), r.choice((None, *[when(40)] * 9))) for i in range(150)]
    lines = [(r.choice((None, r.randrange(170), r.randrange(20))), r.choice((None, when(70), when(70)))) for _ in range(300)]
    clicks = [(when(40), r.choice((1, 1, 2, 3, None)), r.choice(("error", "view", None))) for _ in range(250)] + [(None, 1, "view")]
    for days in (0, 1, 2, 17):  # sessions over midnights, with gaps of a quarter of an hour exactly and one more
        for k in range(150):
            clicks.append((start + days * day + 20 * hour + k * 900_000_000 + (k > 120), 4 + days % 2, r.choice(("view", "view", "error"))))
    clicks += clicks[:9]
    sales += [sales[0], sales[7], (999, 4, "done", start + 9 * 365_000 * day // 1000)]
    lines += [(2, start + 2_500_000 * day // 10)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for width in (1, 28):
            assert got(interval_join.sales_and_sessions(*shop(spark, sales, lines, clicks), width=width), *OVERLAP_COLUMNS) == sorted(allen(sales, lines, clicks), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_interval_overlaps_of_empty_tables(spark):
    for sales, clicks in (([], []), ([(1, 1, "open", 5)], []), ([], [(5, 1, "error")]), ([(1, None, "open", 5)], [(5, None, "error")])):
        assert interval_join.sales_and_sessions(*shop(spark, sales, [], clicks)).collect() == []
    assert got(interval_join.sales_and_sessions(*shop(spark, [(1, 1, "open", 5)], [], [(5, 1, "error")])), "relation", "overlap_slots") == [("equals", None)]


def test_rows_of_a_hot_client_are_bounded_by_slots(spark):
    """20,000 sales and 20,000 clicks of one client within two days: no more classes than pairs of slots."""
    hour = 3_600_000_000
    sales = [(i, 1, "done", i % 40 * hour) for i in range(20_000)]
    clicks = [(i * 7_000_000 % (40 * hour), 1, "view") for i in range(20_000)]
    a, b, c = shop(spark, sales, [], clicks)
    spans = interval_join.sale_spans(a, b).select("client_id", *interval_join.slots("open"))
    others = interval_join.sessions(c).selectExpr("client_id", "0 AS s", "error", "first", "last").select("client_id", *interval_join.slots("error")).selectExpr("*", "1 AS crc")
    assert interval_join.related(spans, others).count() <= 7 * 9


def test_interval_overlaps_equal_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("sales", "sale_lines", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = got(queries.QUERIES["op12_interval_join"](spark, sf), *OVERLAP_COLUMNS)
    assert found and found == sorted(con.execute(f"SELECT {', '.join(OVERLAP_COLUMNS)} FROM ({queries.OP12})").fetchall(), key=str)


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    made.no_truncation()
    made.no_padding()
    return made


def plain(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_bpe_of_random_strings(library):
    r, made = random.Random(9), bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    kinds = [lambda: chr(r.randrange(0x300)), lambda: chr(r.randrange(0x2000, 0x2100)), lambda: r.choice("abcdetnhins'sre  "), lambda: chr(r.randrange(0x300, 0xD800)), lambda: r.choice(["<|endoftext|>", "<|startoftext|>", "ΑΣ ", "İ", "é", "ﬁ", "🙂", "\x1c", "\x85", "'RE"])]
    for n in (1, 5, 40, 200):
        for _ in range(500):
            text = "".join(r.choice(kinds[: r.choice((1, 3, 5))])() for _ in range(n))
            ids = made.encode(text)
            assert (ids, made.decode(ids)) == plain(library, text), repr(text)


def test_bpe_equals_the_library(spark, library):
    r = random.Random(1)
    texts = ["", None, "a", " \n\t", "<|endoftext|>", "Hello<|endoftext|>it's", "ab" * 20_000, "the cat's 12 ½ ñandú ÉTÉ", "x" * 10_000, "".join(r.choice("etaoinshr ") for _ in range(60_000))]
    rows = [*enumerate(texts), (0, ""), (None, "no id"), (7, texts[7])]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, ids int, decoded string")
    want = [(d, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, x in rows for i, t in [plain(library, x or "")]]
    assert got(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert got(bpe.decode(bpe.encode(docs)), "doc_id", "text") == sorted(((d, plain(library, x or "")[1]) for d, x in rows), key=str)
    assert bpe.digests(docs.limit(0)).collect() == []


def test_unreachable_tokens_never_come(library):
    made = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)).words.merges
    reached = {t for ends in made.ends for t in ends}
    assert all(0 <= made.rank[made.left[t]] < made.rank[t] or made.rank[made.left[t]] == -1 for t in reached if made.rank[t] >= 0)


def test_spans_of_a_long_list_of_numbers_take_linear_time():
    """Tenfold text takes about ten times as long, with all spans apart."""
    import time

    from quillspark.llm import pii

    model, took = pii.detector(600, pii.PRECISION), {}
    for n in (300, 3000):
        text = "tel 0222 55 66 77 88 or (415) 555-2671, " * n
        began = time.time()
        found = sorted(model.added(text, []))
        took[n] = time.time() - began
        assert all(a[2] <= b[0] for a, b in zip(found, found[1:], strict=False)) and len(found) >= n
    assert took[3000] < 30 * took[300]


def test_trees_find_a_rule_of_two_features():
    from quillspark.llm.boosting import Boosted

    x = np.random.default_rng(2).normal(size=(3000, 8))
    y = ((x[:, 3] > 0.2) & (x[:, 5] < 0.5)).astype(float)
    model = Boosted(40).fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    flat = Boosted().fit(np.zeros((10, 2)), np.array([1.0] * 5 + [0.0] * 5))
    assert np.allclose(flat.predict(np.zeros((3, 2))), 0.5)
