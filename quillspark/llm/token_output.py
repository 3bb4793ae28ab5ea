"""Token ids in rows of fixed width: best-fit-decreasing packing, and the arrays a trainer reads.

Overlong documents are split losslessly. The pieces of a block of documents are packed by falling
length: a segment tree over the rows' free places finds the row that fits best. Each packed row has its
ids, padded to the width, the cumulative lengths of its pieces, and positions that restart at each
piece. Blocks are cut from each partition's documents, so nothing is shuffled; only the last rows of a
block are not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit_packing import END_ID, cuts, token_ids, vocabulary
from .flow import documents

WIDTH, BLOCK_TOKENS = 1024, 2_000_000
ROWS = "row_id long, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids array<int>, position_ids array<int>, n_tokens int, ids_crc32 long"
_SCHEMA = pa.schema([("row_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64())])


class Free:
    """A segment tree over capacities 0 to width: how many open rows have each; the least that suffices is found in log time."""

    def __init__(self, width: int):
        self.leaf = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaf)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _change(self, free: int, by: int) -> None:
        i = self.leaf + free
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a row with the least free places that are enough."""
        i = self.leaf + need
        while not self.tree[i]:
            while i & 1:  # a right child, or the root's right edge
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaf:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.leaf
        self._change(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows of pieces, each row's in order of falling length."""
    free, rows = Free(width), []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        left, row = free.take(n) or (width, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(int(i))
        if left > n:
            free.put(left - n, row)
    return rows


def packed(docs: DataFrame, width: int = WIDTH, path: str | None = None, pad: int = END_ID) -> DataFrame:
    """Packed rows of all documents' ids, each document's followed by END_ID; null and empty texts are END_ID alone.

    Repeated rows are packed as often as they stand, and null doc_ids stay null in doc_ids. An empty table
    gives no rows. write() stores the id matrices.
    """
    path = path or vocabulary()

    def rows_of(docs_: list, numbers) -> pa.RecordBatch:
        cut_ = [(d, k, s, ids[s : s + n]) for d, ids in docs_ for k, (s, n) in enumerate(cuts(len(ids), width))]
        lengths = np.array([len(p[3]) for p in cut_])
        cols: dict[str, list] = {n: [] for n in _SCHEMA.names}
        for row in best_fit_decreasing(lengths, width):
            own = [cut_[i] for i in row]
            ids, size = np.concatenate([p[3] for p in own]), [len(p[3]) for p in own]
            spare = width - len(ids)
            made = (next(numbers), [p[0] for p in own], [p[1] for p in own], [p[2] for p in own], np.cumsum([0, *size]), np.pad(ids, (0, spare), constant_values=pad), np.concatenate([np.arange(n) for n in [*size, spare]]), len(ids), zlib.crc32(ids.astype(np.uint32).tobytes()))
            for n, x in zip(cols, made, strict=True):
                cols[n].append(x)
        for n in ("ids", "position_ids"):
            flat = np.concatenate(cols[n]).astype(np.int32)
            cols[n] = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(_SCHEMA, cols.values(), strict=True)], schema=_SCHEMA)

    def run(batches):
        numbers = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
        held, total = [], 0
        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), token_ids((x.as_py() for x in b["text"]), path), strict=True):
                held.append((doc, ids))
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield rows_of(held, numbers)
                    held, total = [], 0
        if held:
            yield rows_of(held, numbers)

    return documents(docs).mapInArrow(run, ROWS)


BINARY = "row_id long, ids binary, cu_seqlens binary, position_ids binary"


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet of little-endian 32-bit integers: ids, cumulative segment lengths and positions, one row of the matrix each."""

    def run(batches):
        for b in batches:
            cols = [pa.array([np.array(x, "<u4").tobytes() for x in b[c].to_pylist()], pa.binary()) for c in ("ids", "cu_seqlens", "position_ids")]
            yield pa.RecordBatch.from_arrays([b["row_id"], *cols], names=["row_id", "ids", "cu_seqlens", "position_ids"])

    rows.select("row_id", "ids", "cu_seqlens", "position_ids").mapInArrow(run, BINARY).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """What write() wrote, as arrays again."""

    def run(batches):
        for b in batches:
            cols = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in b[c].to_pylist()], pa.list_(pa.int32())) for c in ("ids", "cu_seqlens", "position_ids")]
            yield pa.RecordBatch.from_arrays([b["row_id"], *cols], names=["row_id", "ids", "cu_seqlens", "position_ids"])

    return spark.read.schema(BINARY).parquet(path).mapInArrow(run, "row_id long, ids array<int>, cu_seqlens array<int>, position_ids array<int>")
