"""What the operators share of Spark: cutting lineage, packed rows for a shuffle, names of columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        top = spark.sparkContext.getCheckpointDir()
    return top


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes all that cut() wrote in this application. Results are lazy and read it, so only their consumer can tell when."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: later stages and retries start from the files."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_buckets(spark: SparkSession) -> int:
    """Buckets of a packed shuffle; they grow with the shuffle partitions the session is sized for."""
    return 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (and named extra columns) alone, so that other columns can't clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in extra])


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are equal ranges of the 64-bit keys, so that sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def ranges_by_bucket(keys: np.ndarray, n: int):
    """(bucket, from, to) of the runs of sorted keys."""
    if len(keys):
        b = bucket_of(keys, n)
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for i, j in zip(at, np.r_[at[1:], len(b)], strict=True):
            yield int(b[i]), int(i), int(j)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of equal length that pack() joined."""
    n, at, out = len(blob) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a few plain DDL types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])
