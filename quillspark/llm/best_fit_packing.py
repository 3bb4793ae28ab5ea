"""Best-fit packing under several capacities at once (vector best-fit).

Every sequence has a residual of tokens, of documents and of attention cost (the sum of squared
lengths). Documents only matter by their length, so a histogram of at most `capacity` lengths, and
not the documents, is planned: decreasing lengths go to the open sequences that score best, and
sequences of equal residuals are kept as one group with a count. The plan is a list of slots
(length, first rank, count, first sequence, offset); a document finds its slot by its rank among
those of its length, which is counted over all data without a sort.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flow import arrow, batch, cut, documents

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long,piece int,start long,length long,ids_crc32 long,part int,rank long"


@lru_cache(1)
def encoder(path: str):
    """tiktoken with the ranks of a byte-level BPE file and the special tokens of the vocabulary beside it, whose ids the tokenizers library gives."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def vocabulary() -> str:
    """The rank file of the vocabulary byte_bpe_50k.json, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(texts, path: str):
    """uint32 ids of each text, then END_ID."""
    enc, end = encoder(path), np.array([END_ID], np.uint32)
    for x in texts:
        yield np.concatenate([enc.encode_to_numpy(x, allowed_special="all").astype(np.uint32), end]) if x else end


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what is over."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((i, capacity) for i in range(head, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of all documents (null text: empty, so the end id alone), with a rank among those of one length and partition."""
    path, schema = path or vocabulary(), arrow(PIECES)

    def run(batches):
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"].to_pylist(), token_ids((x.as_py() for x in b["text"]), path), strict=True):
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return documents(docs).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) for count pieces of each length.

    Of the open sequences that a piece fits in under every capacity, rule "norm" takes the one with
    the least weighted norm of what would be left, "dot" the one with the greatest weighted
    dot-product of demand and residual; shares of the capacities, ties to the older. A piece that
    fits nowhere, not even in an empty sequence, is an error.
    """
    limit = np.array([capacity, max_docs or capacity, max_cost or capacity**2], float)
    w = np.array(weights, float)
    left, first, many = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)  # groups of equal residuals
    slots, opened = [], 0
    for n in sorted((n for n, c in histogram.items() if c), reverse=True):
        need, todo, rank = np.array([n, 1, n * n], float), histogram[n], 0
        if (need > limit).any():
            raise ValueError(f"a piece of {n} tokens exceeds the capacities of an empty sequence")
        while todo:
            fits = (left >= need).all(1)
            if fits.any():
                share = left[fits] / limit
                score = (w * (share - need / limit) ** 2).sum(1) if rule == "norm" else -(w * share * (need / limit)).sum(1)
                g = int(np.flatnonzero(fits)[np.argmin(score)])
            else:
                each = int((limit // need).min())
                left, first, many = np.vstack([left, limit]), np.append(first, opened), np.append(many, max(1, todo // each))
                opened += int(many[-1])
                g = len(many) - 1
            each = min(int((left[g] // need).min()), todo)
            used = max(1, min(int(many[g]), todo // each))
            if used < many[g]:  # only some of the group
                left, first, many = np.vstack([left, left[g]]), np.append(first, first[g] + used), np.append(many, many[g] - used)
                many[g] = used
            for _ in range(each):
                slots.append((n, rank, used, int(first[g]), int(capacity - left[g, 0])))
                left[g] -= need
                rank, todo = rank + used, todo - used
        keep = (left >= 1).all(1)
        if len(keep) > 64 and not keep.all():
            left, first, many = left[keep], first[keep], many[keep]
    return slots


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null or empty texts are packed as their end id. Repeated rows are packed once each; a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, capacity, path))
    by_part = cutted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity, max_docs, max_cost, weights, rule), "l long, from_rank long, many long, first long, offset long")
    ranked = cutted.join(before, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select(*cutted.columns[:5], (F.col("before") + F.col("rank")).alias("rank"))
    # The slots depend on the lengths that occur, not on the documents: a few for each of `capacity` lengths.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l")) & F.col("rank").between(F.col("from_rank"), F.col("from_rank") + F.col("many") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
