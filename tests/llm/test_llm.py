import hashlib
import random
import zlib
from collections import Counter, defaultdict, namedtuple

import numpy as np
import pytest
from brute import base_scores, contamination, fold, near_duplicates, personal, repeats

from pyspark.sql import functions as F

from quillspark.llm import best_fit_packing, decontamination, fingerprints, jaccard_join, lm_scoring, pii, quality, substring_dedup, token_output, toxicity

Counts = namedtuple("Counts", "n v top")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, slice long, node long, d long, k long, held_out string"


def make(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None if t is None else len(t), 1, 2, 3, 4, 5, "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [a + b for a in ("an", "the", "qu", "sch", "éx", "ló") for b in ("ti", "or", "en", "ß", "a", "umm")]
    prose = lambda n: " ".join(r.choice(words) + r.choice(("", "", ".", ",\n")) for _ in range(n))
    passage, out = prose(60), []
    for i in range(120):
        t = prose(r.choice((1, 3, 12, 80, 300)))
        if i % 9 == 0:
            t = f"{t} {passage} {prose(20)}"
        if i % 7 == 0:
            t += f" write a.b{i}@mail.example.com or +1 (222) 555-01{i % 90 + 10}, 10.0.{i}.1 4111 1111 1111 1111."
        if i % 4 == 1:
            t += f" stupid idiot trash worthless {prose(5)}"
        out.append((i, t))
    near = prose(200).split(" ")
    for i in range(12):
        near[r.randrange(len(near))] = f"new{i}"
        out.append((200 + i, " ".join(near)))
    out += [(300, None), (301, ""), (302, "  \n\t "), (303, "One two"), (304, "one TWO"), (305, prose(30) * 200), (306, "x" * 50_000), (5, out[5][1]), (5, out[5][1]), (7, "another text of the same id")]
    return out


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def want(rows):
    return sorted(map(tuple, rows), key=str)


def test_personal_data(spark, rows):
    found = pii.find(make(spark, rows), n_examples=600)
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want(personal(rows))
    odd = ["a@b@c.d e@f.g. @x", "1.2.3.4.5 999.1.1.1", "+12 34 56 78 90+33 1 22 33 44 55 5+12 345 678 90", "..@a.b @@a.b a@b"]
    assert got(pii.find(make(spark, list(enumerate(odd))), n_examples=600), "doc_id", "base_sha256") == [(d, h) for d, *_, h in personal(list(enumerate(odd)))]
    masked = {r.doc_id: r.text for r in pii.redact(make(spark, rows), n_examples=600).collect()}
    assert "<EMAIL>" in masked[7 * 3] and "@" not in masked[7 * 3] and masked[300] is None


def test_trees_separate_and_spans_never_overlap(spark):
    model = pii.Detector(1500)
    text = "please call my phone: (415) 555-2671 or write to mail john (at) example (dot) com today"
    added = model.added(text, [])
    assert all(a[2] <= b[0] for a, b in zip(sorted(added), sorted(added)[1:], strict=False))
    assert model.added("in 2021-10-12 version 1.2.3 costs 12345678", []) == []


def test_near_duplicates(spark, rows):
    found = jaccard_join.near_duplicates(make(spark, rows))
    assert got(found, "doc_id", "n_shingles", "component_id") == want(near_duplicates(rows))
    kept = jaccard_join.representatives(make(spark, rows))
    assert kept.columns == make(spark, rows).columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in near_duplicates(rows)}


def test_divide_skip_agrees_with_all_overlaps():
    r = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(r.integers(0, 60, 40)).astype(np.uint64)
        sets = [np.unique(np.where(r.random(len(base)) < 0.1, r.integers(0, 80, len(base)), base)).astype(np.uint64) for _ in range(15)]
        sets = [s for s in sets if len(s) >= len(base)]
        exact = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, base)) >= 80 * len(np.union1d(s, base))]
        assert jaccard_join.divide_skip(base, jaccard_join.Index(sets)) == exact


def test_the_first_common_shingle_stands_early_enough():
    r = random.Random(1)
    for _ in range(300):
        x = r.sample(range(400), r.randint(1, 120))
        y = [v for v in x if r.random() < 0.93] + r.sample(range(400, 500), r.randint(0, 8))
        if not y or 100 * len(set(x) & set(y)) < 80 * len(set(x) | set(y)):
            continue
        first, both = min(set(x) & set(y)), jaccard_join.overlap(len(x), len(y), 80)
        for s in (x, y):
            at = sorted(s).index(first)
            assert at <= len(s) - both and at < jaccard_join.prefix(len(s), 80)


def test_near_duplicates_by_shuffled_texts(spark, rows):
    assert got(jaccard_join.near_duplicates(make(spark, rows), limit=0), "doc_id", "n_shingles", "component_id") == want(near_duplicates(rows))


def test_near_duplicates_by_rows_of_hot_shingles(spark, rows):
    assert got(jaccard_join.near_duplicates(make(spark, rows), hot=2), "doc_id", "n_shingles", "component_id") == want(near_duplicates(rows))


def test_candidates_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies of one source with one to eight changes: half link to it, and few of the others' pairs are compared."""
    r, made = random.Random(2), {}
    source = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(source))]
    for i in range(1, 700):
        copy = list(source)
        for _ in range(r.choice((1, 2, 3, 3, 4, 5, 8))):
            copy[r.randrange(150)] = f"c{r.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    for name in ("led", "across"):
        monkeypatch.setattr(jaccard_join, name, lambda *a, of=getattr(jaccard_join, name), name=name: made.setdefault((name, len(made)), of(*a)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(found, "doc_id", "n_shingles", "component_id") == want(near_duplicates(rows))
    assert sum(x.count() for x in made.values()) < 8 * len(rows)


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 5, 6, 7, 8), (2, "a b c d e f g", 1, 2, 3, 4), (2, "a b c d e f g", 1, 2, 3, 4), (3, None, 1, 1, 1, 1), (None, "x", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key__ long, key long, d long, doc long")
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_decontamination_in_one_chunk_and_in_many(spark, rows):
    items = [(1, rows[9][1]), (2, "One, TWO"), (3, None), (4, ""), (None, rows[0][1]), (10, rows[3][1]), (1, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    one = got(decontamination.decontaminate(make(spark, rows), bench), *cols)
    assert one == want(contamination(rows, items)) == got(decontamination.decontaminate(make(spark, rows), bench, chunk_bytes=64), *cols)
    clean = {(d, t) for (d, t), c in zip(rows, contamination(rows, items), strict=True) if not c[-1]}
    assert {(r.doc_id, r.text) for r in decontamination.without_contaminated(make(spark, rows), bench).collect()} == clean


def test_segments_are_maximal():
    r = np.random.default_rng(0)

    def slow(x, lo, hi):
        """All maximal segments by taking the best one and going on beside it."""
        best = max(((x[i:j].sum(), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        return slow(x, lo, best[3]) + [(best[3], best[4])] + slow(x, best[4], hi) if best[0] > 1e-12 else []

    for _ in range(60):
        x = r.normal(-0.1, 1, 14)
        assert sorted((a, b) for _, a, b in toxicity.segments(x)) == slow(x, 0, len(x))


def test_toxicity_learns_and_ignores_held_out_labels(spark, rows):
    labels = [(d, int(t is not None and "stupid" in t)) for d, t in rows] + [(None, 1), (9999, None)]
    docs, side = make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = lambda c: toxicity.remainder(c, 4) != 2
    found = toxicity.score(docs, toxicity.fit(docs, side, train)).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found) and len(found) == len(rows)
    flipped = spark.createDataFrame([(d, 1 - y if d is not None and y is not None and fold(d, 4) == 2 else y) for d, y in labels], "doc_id long, toxic int")
    again = toxicity.score(docs, toxicity.fit(docs, flipped, train)).collect()
    assert {(r.doc_id, r.score) for r in found} == {(r.doc_id, r.score) for r in again}
    right = [r.predicted == dict(labels)[r.doc_id] for r in found if r.held_out]
    assert sum(right) >= 0.8 * len(right)


def test_language_model(spark, rows):
    found = lm_scoring.score(make(spark, rows), examples=5000)
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    plain = list(base_scores(rows))
    assert got(found, *cols) == want(p[:5] for p in plain)
    base = sorted((r.doc_id, r.base_score) for r in found.collect())
    assert [d for d, _ in base] == sorted(p[0] for p in plain) and np.allclose([b for _, b in base], [b for _, b in sorted((p[0], p[5]) for p in plain)])


def test_language_model_is_normalised():
    n = 40
    model = lm_scoring.Model(np.arange(n, dtype=np.uint64), np.arange(n), np.log10(np.arange(1, n + 1) + 1.0), np.log10(np.arange(2, n + 3).astype(float)), 900, n)
    model = lm_scoring.train(model, np.random.default_rng(1).integers(0, n, (2000, 3)))
    for one, two in ((0, 3), (n + 1, n + 1), (5, n)):
        every = np.arange(model.outputs)
        assert np.isclose((10 ** model.log10(every, np.full(len(every), one), np.full(len(every), two))).sum(), 1, atol=1e-4)


def test_repeated_passages(spark, rows):
    found = substring_dedup.remove_repeats(make(spark, rows))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want(repeats(rows))


def test_paths_are_cut_at_branches():
    at, flags, text = np.array([0, 1, 2, 3, 7, 8]), np.array([1, 5, 1, 1, 1, 3], np.uint8), np.array([0] * 6)
    start, size = substring_dedup.paths(at, flags, text)
    assert start.tolist() == [0, 2, 7, 8] and size.tolist() == [2, 2, 1, 1]


def ids_of(text):
    return next(best_fit_packing.token_ids([text or ""], best_fit_packing.vocabulary()))


def test_ids_are_those_of_the_tokenizers_library(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [x or "" for _, x in rows] + ["a<|endoftext|>b  \n\n c d 's 123 ﷽ 🙂"]:
        assert ids_of(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_best_fit_packing_round_trip(spark, rows):
    found = best_fit_packing.pack_documents(make(spark, rows)).collect()
    total, seen, byseq = Counter(), defaultdict(list), defaultdict(list)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(ids_of(t))
    for r in found:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
        seen[r.doc_id].append(r.length)
        byseq[r.sequence_id].append((r.offset, r.length))
    assert all(sum(seen[d]) == sum(map(len, x)) for d, x in texts.items())
    for s in byseq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(byseq) <= 1.05 * sum(sum(x) for x in seen.values()) / 1024 + 1 and not total


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    h = {3: 50, 10: 7, 40: 9, 100: 4}
    used = defaultdict(lambda: [0, 0, 0])
    for n, _, many, first, offset in best_fit_packing.plan(h, 100, max_docs=5, max_cost=10_000, weights=(1, 0.5, 0.1), rule=rule):
        for s in range(first, first + many):
            assert used[s][0] == offset
            used[s] = [used[s][0] + n, used[s][1] + 1, used[s][2] + n * n]
    assert all(t <= 100 and d <= 5 and c <= 10_000 for t, d, c in used.values()) and sum(d for _, d, _ in used.values()) == sum(h.values())


def test_token_rows_round_trip(spark, rows):
    back = defaultdict(list)
    for r in token_output.packed(make(spark, rows)).collect():
        assert len(r.ids) == 1024 and r.cu_seqlens[-1] == r.n_tokens
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert r.position_ids[a:b] == list(range(b - a))
            back[doc].append((piece, r.ids[a:b]))
    for d, t in rows:
        if sum(x == d for x, _ in rows) == 1:
            assert [i for _, ids in sorted(back[d]) for i in ids] == ids_of(t).tolist()


def test_written_matrices_come_back(spark, rows, tmp_path):
    packed = token_output.packed(make(spark, rows[:20]))
    token_output.write(packed, f"{tmp_path}/ids")
    cols = ("row_id", "ids", "cu_seqlens", "position_ids")
    assert got(token_output.read(spark, f"{tmp_path}/ids"), *cols) == got(packed, *cols)


def test_segment_tree_is_best_fit():
    r = random.Random(2)
    for _ in range(30):
        lengths = np.array([r.randint(1, 50) for _ in range(60)])
        free = []
        for n in sorted(lengths, reverse=True):
            fit = [f for f in free if f >= n]
            if fit:
                free.remove(min(fit))
            free.append((min(fit) if fit else 50) - n)
        packed = token_output.best_fit_decreasing(lengths, 50)
        assert len(packed) == len(free) and sorted(i for x in packed for i in x) == list(range(60)) and all(lengths[x].sum() <= 50 for x in packed)


def test_fingerprints(spark, rows):
    plain = [(d, t) for d, t in rows if sum(x == d for x, _ in rows) == 1]
    found = {r.doc_id: r for r in fingerprints.compared(make(spark, plain)).collect()}
    for (d, t), (_, after) in zip(plain, plain[1:] + plain[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (found[d].n_chars, found[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[d].near_edited <= 1 and 0 <= found[d].near_next <= 1
    assert len({found[d].fingerprint for d, _ in plain}) == len({t or "" for _, t in plain})
    every = fingerprints.compared(make(spark, rows)).collect()
    assert len(every) == len(rows) and len({r.fingerprint for r in every if r.doc_id == 5}) == 1


def test_fingerprints_add_up(spark):
    a, b = "one two three\nfour five", "six seven\neight"
    rows = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}"), (3, f"{b}\n{a}")], "d long, text string").repartition(2, "d")
    v = fingerprints.vectors(rows, ["d"], ["text"]).cache()
    x = {r.d: (r.text_strong, r.text_lanes) for r in v.collect()}
    assert x[2] == x[3] and x[0] != x[1]
    one, two = v.filter("d = 0").alias("a"), v.filter("d = 1").alias("b")
    joined = one.crossJoin(two)
    s, lanes = fingerprints.combine(F.col("a.text_strong"), F.col("a.text_lanes"), F.col("b.text_strong"), F.col("b.text_lanes"))
    r = joined.select(s.alias("s"), lanes.alias("l")).first()
    assert (r.s, r.l) == x[2]


def test_fingerprints_of_very_many_copies(spark):
    docs = spark.range(70_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    assert fingerprints.compared(docs).groupBy("fingerprint", "near_next").count().collect()[0]["count"] == 70_000


def test_likeness_follows_common_word_pairs(spark):
    r = random.Random(4)
    word, rows, exact = (lambda: f"w{r.randrange(300)}"), [], []
    for i in range(0, 40, 2):
        a = [word() for _ in range(200)]
        b = [word() if r.random() < i / 80 else x for x in a]
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        p, q = (Counter(zip(x, [*x[1:], None], strict=True)) for x in (a, b))
        dot = sum(p[k] * q[k] for k in p)
        exact.append(2 * dot / (sum(v * v for v in p.values()) + sum(v * v for v in q.values())))
    found = {x.doc_id: x.near_next for x in fingerprints.compared(make(spark, rows)).collect()}
    assert np.mean([abs(found[2 * k] - e) for k, e in enumerate(exact)]) < 0.08


def test_quality_features_of_many_short_texts_stay_small():
    import tracemalloc

    import pyarrow as pa

    (_, _, block), *_ = lm_scoring.blocks(pa.array(["ab"] * 10_000), quality.SPACED)
    m = quality.measures(block)
    tracemalloc.start()
    x = quality.Features(block, m)
    x.summed(x.dot(np.ones((1 << quality.SLOT_BITS) + 2 * len(quality.LABELLERS) + 1)), True)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_quality_posteriors_agree_with_plain_expectation_maximisation():
    v = [(1, 1, 0, 1, 1, 1, 1, 1, 1)] * 60 + [(-1, -1, 0, -1, 0, -1, 1, 0, -1)] * 9 + [(1, 0, -1, 1, 1, 1, 1, 1, 0)] * 11
    codes, counts = np.unique(quality.coded(np.array(v)), return_counts=True)
    start = {-1: (0.6, 0.1), 0: (0.3, 0.3), 1: (0.1, 0.6)}
    table, good, votes = [[{x: start[x][c] for x in start} for _ in range(9)] for c in (0, 1)], quality.PRIOR_GOOD, quality.decoded(codes).tolist()
    for _ in range(100):
        p = []
        for row in votes:
            bad_, good_ = (np.prod([table[c][i][x] for i, x in enumerate(row)]) * (1 - good, good)[c] for c in (0, 1))
            p.append(good_ / (bad_ + good_))
        good = min(max(sum(n * q for n, q in zip(counts, p, strict=True)) / sum(counts), 0.01), 0.99)
        for c in (0, 1):
            for i in range(9):
                mass = {x: 10 * start[x][c] + sum(n * (q if c else 1 - q) for n, q, row in zip(counts, p, votes, strict=True) if row[i] == x) for x in start}
                table[c][i] = {x: y / sum(mass.values()) for x, y in mass.items()}
    assert np.allclose(quality.estimate(codes, counts), p, atol=1e-6)


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("7" * 1_000_000, "1." * 500_000, "x" * 1_000_000 + " (at) y (dot) z", "a@" * 300_000, "1.2.3.4." * 100_000):
        pii.base_spans(text)
        pii.candidates(text)
    assert time.time() - began < 60


def test_quality_separates_junk(spark, rows):
    junk = [(1000 + i, "###$ @@@ %% || || ||\n" * 30) for i in range(20)]
    found = {r.doc_id: r for r in quality.classify(make(spark, rows + junk)).collect()}
    assert not any(found[d].keep for d, _ in junk)
    long = [d for d, t in rows if t and len(t.split()) > 60 and d < 200]
    assert sum(found[d].keep for d in long) >= 0.95 * len(long)


def test_empty_tables(spark):
    docs, bench, labels = make(spark, []), spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        pii.find(docs, 300), jaccard_join.near_duplicates(docs), decontamination.decontaminate(docs, bench), toxicity.score(docs, toxicity.fit(docs, labels, lambda c: c.isNotNull())), lm_scoring.score(docs),
        substring_dedup.remove_repeats(docs), best_fit_packing.pack_documents(docs), token_output.packed(docs), fingerprints.compared(docs), quality.classify(docs), jaccard_join.representatives(docs),
    ):
        assert df.collect() == []


def test_language_model_learns_from_every_position_and_outputs_grow():
    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(200))) for i in range(30)]
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in texts], "text": [t for _, t in texts], "held_out": [d % 7 == 2 for d, _ in texts]})
    u = np.unique(np.concatenate([lm_scoring.tokens(b)[0] for _, _, b in lm_scoring.blocks(part["text"], lm_scoring.SPACED, True)]))
    model = lm_scoring.Model(u, np.arange(len(u)), np.zeros(len(u)), np.zeros(len(u) + 1), 1, len(u))
    assert sum(map(len, lm_scoring.positions([part], model))) == 201 * sum(d % 7 != 2 for d, _ in texts)
    own = [lm_scoring.classes([Counts(n=v, v=v, top=lm_scoring.pack(np.arange(min(v, 5000), dtype=np.uint64), np.ones(min(v, 5000), np.int64)))]).outputs for v in (10**5, 10**7)]
    assert own[1] > 2 * own[0]


def test_language_model_has_no_bound_by_default(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_scoring, "fitted", lambda docs, model, n, most=None, **k: seen.append(most) or lm_scoring.train(model, np.zeros((0, 3), np.int32)))
    lm_scoring.score(make(spark, [(i, "a b c") for i in range(9)]))
    assert seen == [None]


def test_generators_propose_parts_and_prefilter_takes_every_address(spark):
    def parts(text, kind):
        return {text[s:e] for s, k, e in pii.candidates(text) if k == kind}

    assert {"555-123-4567", "555-987-6543"} <= parts("call 555-123-4567 555-987-6543", 3)
    assert "(415) 555-2671" in parts("at (415) 555-2671 2024", 3) and "4111 1111 1111 1112" in parts("4111 1111 1111 1112 99", 2)
    assert {"a at b dot c", "c at d dot e", "a at b dot c.f"} <= parts("a at b dot c at d dot e", 0) | parts("a at b dot c.f", 0)
    texts = ["mail jane at host (dot) org now", "contact bob{at}site{dot}net or", "write ann at home [dot] com now", "mail eve at host.org now"]
    found = {r.doc_id: r.spans for r in pii.find(make(spark, list(enumerate([*texts, "we met at noon. then left"])))).collect()}
    assert all(found[i].startswith("email:") for i in range(4)) and found[4] == ""
    model = pii.detector(pii.N_EXAMPLES, pii.PRECISION)
    assert {k for _, k, _ in model.added("the ip 10. 0. 3. 77 is up", [])} == {1}
    assert len(model.added("call 555-123-4567 555-987-6543 today", [])) == 2


def test_decontamination_drops_rows_not_ids_in_many_chunks(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "something else " * 20)], "item_id long, text string")
    bad, rows = bench.first().text, [(None, "clean without an id"), (7, "clean with the id of another"), (8, "clean alone"), (8, "clean alone")]
    docs = make(spark, [*rows, (None, bad), (7, bad)])
    one, many = (decontamination.without_contaminated(docs, bench, chunk_bytes=b) for b in (1 << 20, 32))
    assert many.columns == docs.columns and got(many, "doc_id", "text") == got(one, "doc_id", "text") == want(rows)
