"""Each stage of the pipeline against plain versions on what the stage before kept."""

import random

from brute import contamination, near_duplicates

import corpus_pipeline
from quillspark.llm import best_fit_packing as B
from quillspark.llm import pii


def test_stages(spark, tmp_path):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice("anti sheer quen torb lami ersta onde") + str(r.randrange(90)) for _ in range(n)).replace(" ", "a ")
    item, rows = prose(40), []
    for i in range(60):
        t = prose(120)
        rows.append((i, f"{t} {item}" if i % 10 == 0 else f"{t} mail me@x.org" if i % 10 == 1 else t))
    rows += [(100, rows[2][1]), (101, rows[3][1] + " more"), (102, None), (103, ""), (104, "stupid idiot " * 9)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(x.doc_id, x.text) for x in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, str(tmp_path))
        assert now.columns == docs.columns, name
        got = sorted((x.doc_id, x.text) for x in now.collect())
        if name == "ngram_jaccard":
            assert [d for d, _ in got] == sorted(d for d, _, c in near_duplicates(kept) if d == c)
        elif name == "benchmark_decontamination":
            assert [d for d, _ in got] == sorted(c[0] for c in contamination(kept, [(1, item)]) if not c[-1])
        elif name == "pii":
            assert got == [(d, t and pii.masked(t, pii.base_spans(t))) for d, t in kept]
        else:
            assert got == sorted(kept)  # no label is toxic, so every document stays
        docs, kept = spark.createDataFrame(now.collect(), docs.schema), got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    ids = B.token_ids([t or "" for _, t in kept], B.vocabulary())
    assert sum(x.length for x in packed) == sum(map(len, ids))


def test_run_with_toxic_labels_and_repeated_rows(spark, tmp_path):
    r = random.Random(1)
    prose = lambda n: " ".join(f"{r.choice(('anti', 'sheer', 'quen', 'torb'))}{r.randrange(400)}" for _ in range(n))
    rows = [(i, prose(100) + (" moron scum filth vermin " * 12 if i % 4 == 1 else "")) for i in range(200)]
    rows += [(2, rows[2][1]), (300, rows[6][1]), (301, None), (302, "")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, key__ long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "none of these words are anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, int(d < 200 and d % 4 == 1)) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {d for d, _ in rows if d != 300 and not (d < 200 and d % 4 == 1)}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
