"""Nearest vectors by blocks: every block of one side meets every block of the other in some task, as one product of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, BLOCK_BYTES = 2048, 1 << 22
#: By so much a product may differ from the sum of terms one by one; what lies as near to the k-th best is summed again.
NEAR = 1e-9


def _kept(m: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of each set of equal rows, as others can't be among the first k of anything."""
    _, same = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    begin = np.searchsorted(same[by], same[by])
    return np.sort(by[np.arange(len(by)) - begin < k])


def _packed(k: int | None):
    def run(batches):
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin = v.flatten(), np.cumsum(n) - n
            lacking = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
            dims = n.copy()
            dims[np.searchsorted(begin + n, lacking, side="right")] = 0  # like nothing, as null and empty ones are
            values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                at = at[pc.sort_indices(ids.take(pa.array(at)), null_placement="at_start").to_numpy()]
                size = max(1, min(BLOCK, BLOCK_BYTES // (8 * int(dim) + 1)))
                for i in range(0, len(at), size):
                    own = at[i : i + size]
                    m = np.ascontiguousarray(values[begin[own][:, None] + np.arange(dim)]) if dim else np.empty((len(own), 0))
                    if k is not None:
                        few = _kept(m, k) if dim else np.arange(min(k, len(own)))
                        own, m = own[few], m[few]
                    of = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own)))
                    yield pa.RecordBatch.from_arrays([of, pa.array([int(dim)], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["ids", "dim", "m"])

    return run


def blocks(rows: DataFrame, key: str, vector: str, k: int | None = None) -> DataFrame:
    """(ids, dim, m) of vectors of one length, by id in each block; with k no more than k equal ones."""
    rows = rows.select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(_packed(k), f"ids array<{rows.schema[key].dataType.simpleString()}>, dim int, m binary")


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in the vectors' order."""
    s = np.zeros(len(a))
    for d in range(a.shape[1]):
        s += a[:, d] * b[:, d]
    return s


def _best(t: np.ndarray, a: np.ndarray, k: int):
    """(row, place, score) of the k best of a for each row of t: by falling cosine, then by place."""
    nt, na = np.sqrt(_sums(t, t)), np.sqrt(_sums(a, a))
    k = min(k, len(a))
    for i in range(0, len(t), 256):
        one, norm = t[i : i + 256], nt[i : i + 256, None] * na
        rough = np.where(norm > 0, (one @ a.T) / np.where(norm > 0, norm, 1.0), 0.0) if t.shape[1] == a.shape[1] else np.zeros(norm.shape)
        rough[np.isnan(norm) | np.isnan(rough)] = np.inf  # NaN is the greatest number
        least = np.partition(rough, len(a) - k, axis=1)[:, len(a) - k] - NEAR
        near = rough >= least[:, None]
        flat = ~norm.any(axis=1) | (t.shape[1] != a.shape[1])  # all score 0
        near[flat] = np.arange(len(a)) < k
        row, at = np.nonzero(near)
        score = np.zeros(len(row))
        use = np.flatnonzero(~flat[row] & ~(norm[row, at] == 0))
        if len(use):
            score[use] = _sums(one[row[use]], a[at[use]]) / norm[row[use], at[use]]
        by = np.lexsort((at, -np.where(np.isnan(score), np.inf, score), row))
        row, at, score = row[by], at[by], score[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[kept] + i, at[kept], score[kept]


def _met(k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r] for c in batch.schema.names}
                t, a = (np.frombuffer(x[m].as_buffer()).reshape(len(x[ids].values), x[dim].as_py()) for ids, dim, m in (("ids", "dim", "m"), ("arc_ids", "arc_dim", "arc_m")))
                with np.errstate(all="ignore"):
                    for row, at, score in _best(t, a, k):
                        yield pa.RecordBatch.from_arrays([x["ids"].values.take(pa.array(row)), x["arc_ids"].values.take(pa.array(at)), pa.array(score)], ["id", "arc_id", "score"])

    return run


def candidates(texts: DataFrame, arcs: DataFrame, k: int, few: str) -> DataFrame:
    """(id, arc_id, score): for each vector (id, v) the k nearest of each block of arcs (arc_id, arc_v); few: the side whose blocks are sent to all tasks."""
    one, two = blocks(texts, "id", "v"), blocks(arcs, "arc_id", "arc_v", k).toDF("arc_ids", "arc_dim", "arc_m")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = one.repartition(n).crossJoin(F.broadcast(two)) if few == "arcs" else two.repartition(n).crossJoin(F.broadcast(one))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return met.mapInArrow(_met(k), f"id {kind(texts, 'id')}, arc_id {kind(arcs, 'arc_id')}, score double")
