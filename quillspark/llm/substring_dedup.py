"""Repeated passages by a compacted De Bruijn graph of word windows.

Windows of K words are edges between their first and last K - 1 words. Only edges that occur twice matter:
a window can only do so if its minimizer, the least hash among its runs of SEED words, does. So
1. minimizers of all texts are counted by bucket, and texts learn which of theirs occur twice;
2. these texts' candidate windows (edges, with the words to their left and right) are gathered by bucket,
   once for each slice of texts, which finds the repeated edges and those where paths branch;
3. these flags are joined back to the slices, where each maximal run of repeated edges is cut at the
   branches into nonbranching paths, and its source coordinates give the words to remove.
An edge is held equal to another if two independent hashes (80 bits) of its words, taken at its
coordinates, agree. The words beside an edge are compared by 15 bits: a branch missed so joins two paths
into one, but no word is removed or kept for it.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, U64, Block, blocks, covered, mix, owned, texts, windows
from .flow import arrow, batch, cut, documents, n_buckets, pack, ranges_by_bucket, unpack

K, SEED = 35, 12
_OTHER = U64(0xA0761D6478BD642F)
MANY = np.uint16(0xFFFF)
EDGE = (U64, np.uint16, np.uint16, np.uint16, np.uint8)  # two hashes, left and right word, 1 or 2 for more
WORK = "slice long,bucket int,blob binary,at int,doc_id long,n_words long,kept string,text string"
RESULT = "doc_id long,n_words long,n_removed long,kept_sha256 string,n_paths long"


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (minimum or maximum) of x[i:i + n] for every i that has n values."""
    size = 1
    while 2 * size <= n:
        x, size = least(x[:-size], x[size:]), 2 * size
    return x if size == n else least(x[: len(x) - (n - size)], x[n - size :])


def minimizers(b: Block, h: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of windows, the least seed hash of each, and positions of the seeds that are least in any."""
    at, span = owned(b.first, k), k - seed + 1
    if not len(at):
        return at, np.zeros(0, U64), at
    g = windows(h, seed)
    least = _slide(g, span, np.minimum)
    of_window = np.zeros(len(g) + span, U64)  # windows before each seed; those that cross texts count 0
    of_window[at + span - 1] = least[at]
    most = _slide(of_window, span, np.maximum)[: len(g)]
    chosen = np.flatnonzero((most == g) & (most > 0))
    return at, least[at], chosen


def _seeds(k: int, seed: int, n: int):
    def run(batches):
        for batch_ in batches:
            one, two = batch_["k1"].to_numpy(zero_copy_only=False), batch_["k2"].to_numpy(zero_copy_only=False)
            g, a, b = [], [], []
            for i, _, block in blocks(batch_["text"], SPACED):
                h = block.hashes()
                _, _, at = minimizers(block, h, k, seed)
                if not len(at):
                    continue
                s, t = windows(h, seed)[at], block.text[at]
                order = np.lexsort((t, s))
                s, t = s[order], t[order]
                new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
                twice = np.diff(np.r_[new, len(s)]) > 1
                g.append(s[new])
                a.append(one[i + t[new]])
                b.append(two[i + t[new]] | twice)
            if g:
                g, a, b = (np.concatenate(x) for x in (g, a, b))
                order = np.argsort(g, kind="stable")
                g, a, b = g[order], a[order], b[order]
                rows = [(c, pack(g[x:y], a[x:y], b[x:y])) for c, x, y in ranges_by_bucket(g, n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

    return run


def _twice(table: pa.Table) -> pa.Table:
    """Texts' lists of minimizers that occur at two places or more."""
    parts = [unpack(x, U64, np.int64, np.int64) for x in table["blob"].to_pylist()]
    g, a, b = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(g, kind="stable")
    g, a, b = g[order], a[order], b[order]
    group = np.cumsum(np.r_[False, g[1:] != g[:-1]])
    keep = np.bincount(group, 1 + (b & 1))[group] >= 2
    g, a, b = g[keep], a[keep], b[keep] & ~np.int64(1)
    order = np.lexsort((b, a))
    g, a, b = g[order], a[order], b[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return pa.table({"j1": pa.array(a[at], pa.int64()), "j2": pa.array(b[at], pa.int64()), "seeds": pa.array([g[x:y].tobytes() for x, y in zip(at, np.r_[at[1:], len(g)], strict=True)] if len(at) else [], pa.binary())})


def edges(b: Block, at: np.ndarray, k: int):
    """Sorted distinct edges at the positions (two hashes, left and right word, 1 or 2 for more), and which one each position has."""
    h = b.hashes()
    one, two = windows(h, k)[at], (windows(b.hashes(_OTHER), k)[at] >> U64(48)).astype(np.uint16)
    short = (h >> U64(49)).astype(np.uint16) + np.uint16(2)
    left, right = np.ones(len(at), np.uint16), np.zeros(len(at), np.uint16)
    first, last = b.first[b.text[at]], b.first[b.text[at] + 1]
    has = at > first
    left[has] = short[at[has] - 1]
    has = at + k < last
    right[has] = short[at[has] + k]
    order = np.lexsort((two, one))
    one, two, left, right = one[order], two[order], left[order], right[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    start = np.flatnonzero(new)
    where = np.empty(len(at), np.int64)
    where[order] = np.cumsum(new) - 1
    sides = [np.where(np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start), x[start], MANY) for x in (left, right)]
    return (one[start], two[start], *sides, np.minimum(np.diff(np.r_[start, len(at)]), 2).astype(np.uint8)), where


def _flagged(table: pa.Table) -> pa.Table:
    """For each slice and bucket, in the order of its edges: 1 if repeated, 2 if paths branch before it, 4 if after."""
    parts = [unpack(x, *EDGE) for x in table["blob"].to_pylist()]
    one, two, left, right, many = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((two, one))
    one, two, left, right = one[order], two[order], left[order], right[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    flags = (np.add.reduceat(many[order].astype(np.int64), start) >= 2).astype(np.uint8)
    for x, bit in ((left, 2), (right, 4)):
        low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
        flags |= np.where((low != high) | (high == MANY), bit, 0).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = flags[group]
    edge = np.cumsum([0, *(len(p[0]) for p in parts)])
    return pa.table({"slice": table["slice"], "bucket": table["bucket"], "blob": pa.array([out[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())})


def _candidates(k: int, seed: int, n: int):
    """Texts without candidate windows are done; others are kept with them, and their edges sent to buckets."""
    schema = arrow(WORK)

    def run(batches):
        count, part = 0, TaskContext.get().partitionId()
        for b in batches:
            docs, lists, column = b["doc_id"], b["seeds"].to_pylist(), b["text"]
            idle = np.array([not x for x in lists], bool)
            data, offsets = texts(column.filter(pa.array(idle)))
            whole = data.tobytes()
            words = [whole[i:j].split() for i, j in zip(offsets, offsets[1:], strict=False)]
            m = len(words)
            yield batch(schema, slice=[None] * m, bucket=[-2] * m, blob=[None] * m, at=[None] * m, doc_id=docs.filter(pa.array(idle)), n_words=[len(w) for w in words], kept=[hashlib.sha256(b" ".join(w)).hexdigest() for w in words], text=[None] * m)
            if idle.all():
                continue
            docs, column, lists = docs.filter(pa.array(~idle)), column.filter(pa.array(~idle)), [x for x in lists if x]
            for i, j, block in blocks(column):
                name, m = (part << 32) + count, j - i
                count += 1
                at, least, _ = minimizers(block, block.hashes(), k, seed)
                salt = mix(np.arange(m).astype(U64))
                parts = [np.frombuffer(x, U64) for blobs in lists[i:j] for x in [b"".join(blobs)]]
                known = np.unique(np.concatenate([mix(p ^ s) for p, s in zip(parts, salt, strict=True)]))
                mine = mix(least ^ salt[block.text[at]])
                at = at[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine]
                mark = np.zeros(len(block), bool)
                mark[at] = True
                marks = [np.packbits(mark[x:y]).tobytes() for x, y in zip(block.first, block.first[1:], strict=False)]
                yield batch(schema, slice=[name] * m, bucket=[-1] * m, blob=marks, at=list(range(m)), doc_id=docs[i:j], n_words=block.count, kept=[None] * m, text=column[i:j].fill_null(""))
                if len(at):
                    e, _ = edges(block, at, k)
                    rows = [(c, pack(*(x[s:t] for x in e))) for c, s, t in ranges_by_bucket(e[0], n)]
                    r = len(rows)
                    yield batch(schema, slice=[name] * r, bucket=[x[0] for x in rows], blob=[x[1] for x in rows], at=[None] * r, doc_id=[None] * r, n_words=[None] * r, kept=[None] * r, text=[None] * r)

    return run


def paths(at: np.ndarray, flags: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the nonbranching paths of repeated edges, in order of their coordinates."""
    keep = (flags & 1) > 0
    at, flags, text = at[keep], flags[keep], text[keep]
    if not len(at):
        return at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | ((flags[:-1] & 4) > 0) | ((flags[1:] & 2) > 0)]
    start = np.flatnonzero(new)
    return at[start], np.diff(np.r_[start, len(at)])


def _removed(k: int):
    schema = arrow(RESULT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        rows = []
        if left.num_rows:
            column = left["text"].combine_chunks()
            data, offsets = texts(column)
            block = Block(data, offsets, SPACED, False)
            marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(c)).astype(bool) if x else np.zeros(int(c), bool) for x, c in zip(left["blob"].to_pylist(), block.count, strict=True)]
            at = np.flatnonzero(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
            gone, n_paths = np.zeros(len(block), bool), np.zeros(block.n_texts, np.int64)
            if len(at):
                _, where = edges(block, at, k)
                got = right.sort_by("bucket")
                flags = np.frombuffer(b"".join(got["blob"].to_pylist()), np.uint8)[where]
                start, size = paths(at, flags, block.text[at])
                gone = covered(len(block), start, size + k - 1)
                n_paths = np.bincount(block.text[start], minlength=block.n_texts)
            raw = data.tobytes()
            for t, doc in enumerate(left["doc_id"].to_pylist()):
                lost = gone[block.first[t] : block.first[t + 1]]
                kept = compress(raw[offsets[t] : offsets[t + 1]].split(), (~lost).tolist())
                rows.append((doc, len(lost), int(lost.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), int(n_paths[t])))
        return pa.Table.from_batches([batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))], schema) if rows else schema.empty_table()

    return run


def remove_repeats(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_paths (compacted repeated paths) of every document.

    Null texts have no words. Of repeated rows each is a document of its own, so their windows are
    repeated. Texts under k words keep all. Rows with a null doc_id are kept apart by their text.
    """
    n = n_buckets(docs.sparkSession)
    # The low bit of k2 is free for a mark.
    rows = documents(docs).withColumn("k1", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("k2", F.xxhash64("text").bitwiseAND(F.lit(-2)))
    twice = rows.select("k1", "k2", "text").mapInArrow(_seeds(k, seed, n), "bucket int, blob binary").groupBy("bucket").applyInArrow(_twice, "j1 long, j2 long, seeds binary")
    lists = twice.groupBy("j1", "j2").agg(F.collect_list("seeds").alias("seeds"))  # a text's own minimizers
    work = cut(rows.join(lists, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left").select("doc_id", "text", "seeds").mapInArrow(_candidates(k, seed, n), WORK))
    flags = work.filter("bucket >= 0").select("slice", "bucket", "blob").groupBy("bucket").applyInArrow(_flagged, "slice long, bucket int, blob binary")
    rest = work.filter("bucket = -1").select("slice", "at", "blob", "doc_id", "text").groupBy("slice").cogroup(flags.groupBy("slice")).applyInArrow(_removed(k), RESULT)
    return work.filter("bucket = -2").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("kept").alias("kept_sha256"), F.lit(0).cast("long").alias("n_paths")).unionByName(rest)
