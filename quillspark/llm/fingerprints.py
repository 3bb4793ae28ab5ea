"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A paragraph is a line. Its wide vector has STRONG lanes of 48 bits, which are digits of the paragraph's SHA-256, and
LANES lanes of 16 bits that count its word pairs with signs. A document's fingerprint is the sum of
its paragraphs' vectors modulo 2**48 and 2**16: the order of paragraphs doesn't matter, and vectors of
inserted or deleted paragraphs are added or taken off (combine). Strong lanes decide equality; the others
give a likeness, 2ab / (aa + bb) of the two vectors, an unbiased estimate of the share of common
word pairs with a standard error of about LANES ** -0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flow import cut, documents

LANES, STRONG = 256, 4
_MASK, _VALUE = (1 << 48) - 1, (1 << 52) - 1
_ID = -(2**63)


def _code(lane: Column | int, value: Column) -> Column:
    """A lane and a value of -1 or more in one number, so that one array holds all lanes' parts."""
    lane = F.lit(lane) if isinstance(lane, int) else lane
    return F.shiftleft(lane.cast("long"), 52).bitwiseOR(value.cast("long") + 1)


def strong(text: Column) -> list[Column]:
    """The strong lanes of a text: sums of parts of its paragraphs' SHA-256, each of digits of its own."""
    hashes = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))

    def lane(i: int) -> Column:
        digits = lambda h: F.conv(F.substring(h, 12 * i + 1, 12), 16, 10).cast("long")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: (total + digits(h)).bitwiseAND(_MASK))

    return [lane(i) for i in range(STRONG)]


def pairs(text: Column, base: int) -> Column:
    """Codes of a text's word pairs, each within a paragraph; the last word of one is a pair with nothing."""

    def code(h: Column) -> Column:
        return _code(h.bitwiseAND(LANES - 1) + base, F.when(h.bitwiseAND(LANES) == 0, 1).otherwise(-1))

    return F.flatten(F.transform(F.transform(F.split(text, "\n"), lambda p: F.split(p, " ")), lambda ws: F.transform(ws, lambda w, i: code(F.xxhash64(w, F.get(ws, i + 1))))))


def wrapped(lane: Column) -> Column:
    """A sum modulo 2**16, as a signed number."""
    return ((lane + 32768).bitwiseAND(65535) - 32768).cast("short")


def likeness(a: Column, b: Column, a_strong: Column, b_strong: Column) -> Column:
    """1 for equal strong lanes, else the vectors' likeness from 0 to 1."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = dot(a, a) + dot(b, b)
    return F.when(a_strong == b_strong, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / size)))


def written(strong_lanes: Column, lanes: Column) -> Column:
    """A fingerprint as text: 12 hex digits for each strong lane, 4 for each other."""
    head = F.array_join(F.transform(strong_lanes, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")
    return F.concat(head, F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(65535))), 4, "0")), ""))


def combine(strong_lanes: Column, lanes: Column, other_strong: Column, other_lanes: Column, sign: int = 1) -> tuple[Column, Column]:
    """The fingerprint after paragraphs with another fingerprint are inserted (sign 1) or deleted (-1)."""
    return (
        F.zip_with(strong_lanes, other_strong, lambda x, y: (x + sign * y).bitwiseAND(_MASK)),
        F.zip_with(lanes, other_lanes, lambda x, y: wrapped(x.cast("int") + sign * y.cast("int"))),
    )


def vectors(rows: DataFrame, keys: list[str], texts: list[str], meta: list[Column] = ()) -> DataFrame:
    """keys, then for each text column {name}_lanes and {name}_strong, then meta0, ... (0 or more, below 2**51).

    Rows of equal keys must be equal. With rows partitioned by the keys there is no further shuffle. Every
    lane is sent at least once, so that the sorted lanes are a dense vector.
    """
    wide = LANES + STRONG
    parts = [F.transform(F.sequence(F.lit(0), F.lit(LANES * len(texts) - 1)), lambda i: _code(F.floor(i / LANES) * wide + i % LANES, F.lit(0)))]
    for k, t in enumerate(texts):
        parts += [pairs(F.col(t), k * wide), F.array(*[_code(k * wide + LANES + i, x) for i, x in enumerate(strong(F.col(t)))])]
    end = wide * len(texts)
    parts.append(F.array(*[_code(end + i, x) for i, x in enumerate([F.lit(1), *meta])]))
    sums = rows.select(*keys, F.explode(F.concat(*parts)).alias("code")).groupBy(*keys, F.shiftright("code", 52).alias("lane")).agg(F.sum(F.col("code").bitwiseAND(_VALUE) - 1).alias("v"))
    dense = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "v"))), lambda x: x["v"]).alias("all"))
    one = dense.withColumn("copies", F.get("all", F.lit(end))).withColumn("all", F.when(F.col("copies") > 1, F.expr("transform(all, v -> v div copies)")).otherwise(F.col("all")))
    out = []
    for k, t in enumerate(texts):
        out += [F.transform(F.slice("all", k * wide + 1, LANES), wrapped).alias(f"{t}_lanes"), F.slice("all", k * wide + LANES + 1, STRONG).alias(f"{t}_strong")]
    return one.select(*keys, "copies", *out, *[F.get("all", F.lit(end + 1 + i)).alias(f"meta{i}") for i in range(len(meta))])


def successors(ids: DataFrame) -> DataFrame:
    """ids (d, k) with the next in ascending order (nd, nk), after the last the first; sorted in ranges, no range whole on one machine."""
    n = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(ids.repartitionByRange(n, "d", "k").withColumn("range", F.spark_partition_id()))
    first = ranged.groupBy("range").agg(F.min(F.struct("d", "k")).alias("first"))
    order = Window.orderBy("range")  # a row for each range
    after = first.withColumn("after", F.coalesce(F.lead("first").over(order), F.first("first").over(order))).select("range", "after")
    lead = ranged.withColumn("next", F.lead(F.struct("d", "k")).over(Window.partitionBy("range").orderBy("d", "k")))
    return lead.join(F.broadcast(after), "range").withColumn("next", F.coalesce("next", "after")).select(*ids.columns, F.col("next.d").alias("nd"), F.col("next.k").alias("nk"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text with its last floor(n / 2) code points replaced by as many from the
    beginning of the next document, by ascending doc_id. Null texts are empty; a null doc_id comes first.
    Rows of one doc_id follow each other by a hash of their text; repeated rows are one document for
    the order and give a row each. A single document is its own next.
    """
    rows = documents(docs).select(F.coalesce("doc_id", F.lit(_ID)).alias("d"), F.xxhash64("text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("d", "k").agg(F.max(F.floor(F.char_length("text") / 2)).alias("half"), F.count("*").alias("n"))
    after = cut(successors(ids))
    heads = rows.join(after.select(F.col("d").alias("pd"), F.col("k").alias("pk"), "half", "nd", "nk"), (F.col("d") == F.col("nd")) & (F.col("k") == F.col("nk"))).select("pd", "pk", F.expr("substring(text, 1, int(half))").alias("head")).groupBy("pd", "pk").agg(F.min("head").alias("head"))
    both = rows.join(heads, (F.col("d") == F.col("pd")) & (F.col("k") == F.col("pk"))).select("d", "k", "text", F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), "head").alias("edited"))
    both = both.dropDuplicates(["d", "k"])  # repeated rows are hashed once; n counts them
    digest = F.sha2("edited", 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    found = cut(vectors(both, ["d", "k"], ["text", "edited"], [F.char_length("text"), *parts]))
    other = found.select(F.col("d").alias("nd"), F.col("k").alias("nk"), F.col("text_lanes").alias("next_lanes"), F.col("text_strong").alias("next_strong"))
    out = found.join(after.drop("half"), ["d", "k"]).join(other, ["nd", "nk"])
    out = out.select(
        F.when(F.col("d") != _ID, F.col("d")).alias("doc_id"),
        F.col("meta0").alias("n_chars"),
        F.array_join(F.array(*[F.lpad(F.lower(F.hex(F.col(f"meta{i}"))), 8, "0") for i in range(1, 9)]), "").alias("edited_sha256"),
        written(F.col("text_strong"), F.col("text_lanes")).alias("fingerprint"),
        written(F.col("edited_strong"), F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("text_lanes"), F.col("edited_lanes"), F.col("text_strong"), F.col("edited_strong")).alias("near_edited"),
        likeness(F.col("text_lanes"), F.col("next_lanes"), F.col("text_strong"), F.col("next_strong")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    )
    return out.drop("copy")
