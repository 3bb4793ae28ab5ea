"""Rewritten links against a plain version."""

import random
import re

from quillspark.operators import rewrite as W

LINK = re.compile(r"\[\[([^\]|#]+)(\|([^\]]*))?\]\]")


def plain(content, names):
    start = 0
    if content.startswith("---") and (k := content[3:].find("\n---")) >= 0:
        start = 3 + k + 4
        start += content[start : start + 1] == "\n"
    links = []

    def new(m):
        to = names.get(m[1])
        if to is None or to == m[1]:
            return m[0]
        links.append((m[0], f"[[{to}|{m[3] if m[2] is not None else m[1]}]]"))
        return links[-1][1]

    return content[:start] + LINK.sub(new, content[start:]), links


def test_links_lead_to_files(spark):
    notes = [("n1", "Alpha", "a/b/one.md"), ("n2", "n1", "two.md"), ("n3", "Alpha", "x/three.md"), ("n4", None, None), ("n5", "", "q/f.md.md"), ("four", "Four", "four.md"), ("n6", "al", "x/six.txt")]
    aliases = [("n3", "al"), ("n2", "be"), ("n1", None), ("n4", "no"), ("n5", "be")]
    names = {"n1": "one", "n2": "two", "n3": "three", "n5": "f.md", "four": "four", "n6": "six.txt", "Alpha": "one", "Four": "four", "al": "six.txt", "be": "two"}
    found = W.stems(spark.createDataFrame(notes, "id string, title string, path string"), spark.createDataFrame(aliases, "id string, alias string"))
    assert {r.name: r.stem for r in found.collect()} == names
    r = random.Random(5)
    bits = ["[[", "]]", "|", "Alpha", "n1", "al", "Four", "four", "be", "#h", "\n---", "---", "\n", " é ", "![[", "]", "[[n2]]", "[[Alpha|x]]"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice((3, 12, 40)))) for _ in range(250)]
    texts += ["---\nsee: [[n1]]\n---\n[[n1]]", "--- [[n1]]", "---\n---[[n1]]", "", "[[n1|]] [[n1|a|b]] [[four]]"]
    rows = [(f"p{i}", t) for i, t in enumerate(texts)] + [("null", None)]
    got = {x.path: (x.content, [tuple(k) for k in x.links], x.n_fixed) for x in W.fixed(spark.createDataFrame(rows, "path string, content string"), spark.createDataFrame(notes, "id string, title string, path string"), spark.createDataFrame(aliases, "id string, alias string")).collect()}
    want = {p: (*plain(t, names), len(plain(t, names)[1])) for p, t in rows if t is not None and plain(t, names)[1]}
    assert got == want and len(want) > 60


def test_bodies_are_made_once(spark):
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        calls.add(1)
        return text

    files = spark.range(10).select(F.concat(F.lit("p"), "id").alias("path"), told(F.lit("see [[a]]")).alias("content"))
    notes = spark.createDataFrame([("n", "a", "x/file.md")], "id string, title string, path string")
    found = W.fixed(files, notes, notes.select("id", F.lit(None).cast("string").alias("alias")))
    assert {x.content for x in found.collect()} == {"see [[file|a]]"} and calls.value == 10
