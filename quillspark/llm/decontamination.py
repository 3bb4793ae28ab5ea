"""Benchmark decontamination: training texts are scanned for normalised windows of test items.

The items' windows go to the executors as a hash set in sorted arrays, about ten bytes for each of their text, in chunks of
CHUNK_BYTES of text (one chunk for usual benchmarks, one scan for each chunk beyond that). Every hit of a hash is
verified word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, Block, blocks, covered, owned, pieces, texts, windows
from .flow import arrow, batch, cut, documents

WINDOW, CHUNK_BYTES = 13, 16 << 20
FOUND = "row long,doc_id long,n_words long,hits binary,items binary"
RESULT = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean"


class Windows:
    """The windows of some items in arrays: by length, sorted hashes, and the first word and item of each."""

    def __init__(self, ids: list, column, window: int):
        self.names = sorted({str(x) for x in ids if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        item = np.array([-1 if x is None else number[str(x)] for x in ids], np.int32)
        data, offsets = texts(column)
        held, words, found = [], [np.zeros((0, 2), np.int32)], {}
        n_bytes = n_words = 0
        for i, j in pieces(data, offsets):
            b = Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM, True)
            h = b.hashes()
            for k in np.unique(np.minimum(b.count[b.count > 0], window)).tolist():
                at = owned(b.first, k)
                at = at[(np.minimum(b.count[b.text[at]], window) == k) & (item[i + b.text[at]] >= 0)]
                found.setdefault(k, []).append((windows(h, k)[at], (n_words + at).astype(np.int32), item[i + b.text[at]]))
            held.append(b.data)
            words.append((np.stack([b.start, b.end], 1) + n_bytes).astype(np.int32))
            n_bytes, n_words = n_bytes + len(b.data), n_words + len(b)
        self.data, self.words = np.concatenate([np.zeros(0, np.uint8), *held]), np.concatenate(words)
        self.by_length = {}
        for k, parts in found.items():
            h, at, who = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, who, h))
            h, at, who = h[order], at[order], who[order]
            # Of an item's equal windows one stays. like: whether the words are those of the first of the same hash.
            like = np.ones(len(h), bool)
            first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0)) if len(h) else at
            for x in np.flatnonzero(first != np.arange(len(h))):
                like[x] = self.same(at[x], k, self.phrase(at[first[x]], k))
            keep = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | ~like[1:]] if len(h) else like
            self.by_length[k] = h[keep], at[keep], who[keep], like[keep]

    def phrase(self, at: int, k: int) -> list[bytes]:
        return [self.data[i:j].tobytes() for i, j in self.words[at : at + k]]

    def same(self, at: int, k: int, words: list[bytes]) -> bool:
        return self.phrase(at, k) == words

    def scan(self, b: Block):
        """(window length, first word, item ids) of every verified occurrence."""
        h = b.hashes()
        for k, (known, at, who, like) in self.by_length.items():
            mine = owned(b.first, k)
            w = windows(h, k)[mine]
            if not len(w) or not len(known):
                continue
            low = np.minimum(np.searchsorted(known, w), len(known) - 1)
            hit = np.flatnonzero(known[low] == w)
            for p, x in zip(mine[hit], low[hit], strict=True):
                y = x + int(np.searchsorted(known[x:], known[x], "right"))
                words = [b.word(i) for i in range(p, p + k)]
                good = like[x:y] if self.same(at[x], k, words) else np.zeros(y - x, bool)
                if not like[x:y].all():  # two windows of one hash
                    good = np.array([self.same(a, k, words) for a in at[x:y]])
                if good.any():
                    yield k, int(p), {self.names[i] for i in who[x:y][good]}


def _chunks(benchmark: DataFrame, most: int):
    """Tables of items of at most so many bytes of text, or one item; only one is on the driver at a time."""
    ids, rows, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        size = len((r.text or "").encode())
        if rows and held + size > most:
            yield ids, pa.array(rows, pa.string())
            ids, rows, held = [], [], 0
        ids.append(r.item_id)
        rows.append(r.text)
        held += size
    yield ids, pa.array(rows, pa.string())


def occurrences(docs: DataFrame, known, several: bool) -> DataFrame:
    """Per document: hit words as a packed list of (first word, length) pairs, and the items' ids, of one chunk."""
    schema = arrow(FOUND if several else RESULT)

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            for i, j, block in blocks(b["text"], ALNUM, True):
                spans: list[list] = [[] for _ in range(j - i)]
                items: list[set] = [set() for _ in range(j - i)]
                for k, p, who in known.value.scan(block):
                    t = block.text[p]
                    spans[t].append((p - block.first[t], k))
                    items[t] |= who
                for t in range(j - i):
                    n, s = int(block.count[t]), np.array(spans[t], np.int64).reshape(-1, 2)
                    row = (b["row"][i + t].as_py(), b["doc_id"][i + t].as_py(), n, s.tobytes(), "\0".join(sorted(items[t])).encode()) if several else (b["doc_id"][i + t].as_py(), *judged(n, s, items[t]))
                    for name, x in zip(schema.names, row, strict=True):
                        out[name].append(x)
            yield batch(schema, **out)

    return docs.mapInArrow(run, FOUND if several else RESULT)


def judged(n: int, spans: np.ndarray, items: set[str]) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = int(covered(n, spans[:, 0], spans[:, 1]).sum()) if len(spans) else 0
    return n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and 20 * hit >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null texts have no words; items without words have no window, and items without id are ignored.
    Repeated rows give a row each. An empty benchmark hits nothing.
    """
    chunks = [docs.sparkSession.sparkContext.broadcast(Windows(ids, column, window)) for ids, column in _chunks(benchmark, chunk_bytes)]
    if len(chunks) == 1:
        return occurrences(documents(docs), chunks[0], False)
    return merged(cut(documents(docs).withColumn("row", F.monotonically_increasing_id())), chunks).drop("row")


def merged(rows: DataFrame, chunks: list) -> DataFrame:
    """The result, and the row's number, of each of rows (doc_id, text, row) over several chunks."""
    found = occurrences(rows, chunks[0], True)
    for c in chunks[1:]:
        found = found.union(occurrences(rows, c, True))
    schema = arrow(f"{RESULT},row long")

    def merge(table):
        spans = np.frombuffer(b"".join(table["hits"].to_pylist()), np.int64).reshape(-1, 2)
        items = {x.decode() for blob in table["items"].to_pylist() for x in blob.split(b"\0") if x}
        n, *rest = judged(table["n_words"][0].as_py(), spans, items)
        return pa.Table.from_batches([batch(schema, **{c: [x] for c, x in zip(schema.names, (table["doc_id"][0].as_py(), n, *rest, table["row"][0].as_py()), strict=True)})])

    return found.groupBy("row").applyInArrow(merge, f"{RESULT},row long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of the documents that aren't contaminated; with one chunk in one scan, so that texts aren't shuffled.

    Every row is judged by its own text, whatever its doc_id. Null and empty texts stay, and so does all with an empty benchmark.
    """
    chunks = [docs.sparkSession.sparkContext.broadcast(Windows(ids, column, window)) for ids, column in _chunks(benchmark, chunk_bytes)]
    if len(chunks) > 1:
        rows = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
        verdict = merged(documents(rows.select("doc.doc_id", "doc.text", "row"), "row"), chunks).filter("contaminated").select("row")
        return rows.join(verdict, "row", "left_anti").select("doc.*")

    def run(batches, known=chunks[0]):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for i, j, block in blocks(b["text"], ALNUM, True):
                spans: list[list] = [[] for _ in range(j - i)]
                for k, p, _ in known.value.scan(block):
                    spans[block.text[p]].append((p - block.first[block.text[p]], k))
                for t, s in enumerate(spans):
                    if s:
                        keep[i + t] = not judged(int(block.count[t]), np.array(s, np.int64).reshape(-1, 2), set())[-1]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
