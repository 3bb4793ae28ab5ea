"""Distinct words that collide under polynomial hashes modulo a power of two, and rows without ids."""

import numpy as np
import pyarrow as pa
import pytest
from brute import base_scores, contamination, near_duplicates, repeats

from quillspark.llm import arrays, decontamination, jaccard_join, lm_scoring, substring_dedup


def thue_morse(letters):
    return "".join(letters[i.bit_count() % 2] for i in range(1024))


ONE, TWO = thue_morse("ab"), thue_morse("ba")


@pytest.fixture(scope="module")
def rows():
    common = " ".join(f"w{i}" for i in range(34))
    return [(1, f"{common} {ONE}"), (2, f"{common} {TWO}"), (3, ONE), (4, TWO), (5, f"{common} {ONE} again"), (6, "a b c d " + ONE), (7, "a b c d " + TWO)]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_words_of_every_length_have_hashes_of_their_own():
    words = [c * n for n in range(1, 200) for c in "abc"] + [ONE, TWO, ONE + TWO, TWO + ONE] + [f"{i:08d}" for i in range(3000)] + [f"{i:016d}" for i in range(3000)]
    for seed in (arrays._P, substring_dedup._OTHER):
        _, _, block = next(arrays.blocks(pa.array([" ".join(words)]), most=1 << 30))
        h = block.hashes(seed)
        assert len(h) == len(words) == len(np.unique(h))
        _, _, each = next(arrays.blocks(pa.array(["x " + " y ".join(reversed(words))]), most=1 << 30))
        assert np.array_equal(each.hashes(seed)[1::2], h[::-1])


def test_near_duplicates(spark, rows):
    for limit in (0, 1000):
        assert got(jaccard_join.near_duplicates(make(spark, rows), limit=limit), "doc_id", "n_shingles", "component_id") == sorted(near_duplicates(rows), key=str)


def test_repeated_passages(spark, rows):
    assert got(substring_dedup.remove_repeats(make(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(repeats(rows), key=str)


def test_counts_of_words(spark, rows):
    found = got(lm_scoring.score(make(spark, rows), examples=100), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
    want = sorted(((d, n, k, t, b) for d, _, n, k, t, b in base_scores(rows)), key=str)
    assert [x[:4] for x in found] == [x[:4] for x in want] and np.allclose([x[4] for x in found], [x[4] for x in want])


def test_contamination(spark, rows):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [(1, ONE), (2, rows[0][1])]
    assert got(decontamination.decontaminate(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")), *cols) == sorted(contamination(rows, items), key=str)


def test_null_ids_leave_a_component_its_least_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (6, text), (None, text + " more"), (None, "alone"), (9, "alone too")]
    found = got(jaccard_join.near_duplicates(make(spark, rows)), "doc_id", "component_id")
    assert found == [(5, 5), (6, 5), (9, 9), (None, 5), (None, 5), (None, None)]
    kept = jaccard_join.representatives(make(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [5, 9, None]


def test_scores_do_not_depend_on_the_layout(spark):
    """The same model and scores for any partitioning, and a gain over single words on rows left out."""
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]

    def text():
        out = [r.choice(words)]
        for _ in range(60):  # each word has two usual successors
            i = int(out[-1][1:])
            out.append(words[(2 * i + r.randrange(2)) % 300] if r.random() < 0.9 else r.choice(words))
        return " ".join(out)

    rows = spark.createDataFrame([(i, text()) for i in range(1200)] + [(None, "a b"), (3, None)], "doc_id long, text string").cache()
    runs = []
    for n in (1, 7):
        found = lm_scoring.score(rows.repartition(n)).collect()
        runs.append(sorted((str(x.doc_id), x.score, x.base_score, x.held_out, x.n_tokens) for x in found))
    assert np.allclose([x[1] for x in runs[0]], [x[1] for x in runs[1]], atol=1e-6)
    held = [x for x in runs[0] if x[3]]
    assert sum(x[1] - x[2] for x in held) > 0.3 * sum(x[4] for x in held)
