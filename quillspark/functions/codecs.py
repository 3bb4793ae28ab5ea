"""Vectors as bytes of other stores: dense, sparse and multi-vector, little-endian 32-bit floats. Arrow batches, not rows.

Empty and null values encode to null; null or empty bytes decode to null, of sparse vectors to an empty map. Bytes of
a wrong length are an error, as they are damage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, MapType


def _each(values: pd.Series, of) -> pd.Series:
    return pd.Series([None if x is None or len(x) == 0 else of(x) for x in values], dtype=object)


def _whole(blob: bytes, size: int) -> bytes:
    if len(blob) % size:
        raise ValueError(f"{len(blob)} bytes aren't whole items of {size}")
    return blob


@F.pandas_udf(BinaryType())
def encode_dense(vectors: pd.Series) -> pd.Series:
    return _each(vectors, lambda x: np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_dense(blobs: pd.Series) -> pd.Series:
    return _each(blobs, lambda x: np.frombuffer(_whole(x, 4), "<f4"))


_PAIR = np.dtype([("id", "<i4"), ("weight", "<f4")])


@F.pandas_udf(BinaryType())
def encode_sparse(maps: pd.Series) -> pd.Series:
    """(id, weight) pairs by ascending id."""
    return _each(maps, lambda x: np.array(sorted(dict(x).items()), _PAIR).tobytes())


@F.pandas_udf(MapType(IntegerType(), FloatType()))
def decode_sparse(blobs: pd.Series) -> pd.Series:
    return pd.Series([{int(i): float(w) for i, w in np.frombuffer(_whole(x or b"", 8), _PAIR)} for x in blobs], dtype=object)


@F.pandas_udf(BinaryType())
def encode_multi(matrices: pd.Series) -> pd.Series:
    """The vectors' size, then all vectors."""

    def one(rows) -> bytes:
        flat = np.stack([np.asarray(r, "<f4") for r in rows])
        return np.uint32(flat.shape[1]).astype("<u4").tobytes() + flat.tobytes()

    return _each(matrices, one)


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def decode_multi(blobs: pd.Series) -> pd.Series:
    def one(blob: bytes) -> list:
        size = int(np.frombuffer(blob[:4], "<u4")[0]) if len(blob) >= 4 else 0
        if not size:
            raise ValueError("a matrix without a size")
        return list(np.frombuffer(_whole(blob[4:], 4 * size), "<f4").reshape(-1, size))

    return _each(blobs, one)
