"""What operators share of the session: tables that cut lineage, in the folder that all machines reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top}/quillspark-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again: it is computed once, and later stages and retries start from the files."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all that cut() wrote in this application, once results that read it are consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
