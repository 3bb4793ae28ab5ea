"""The driver's tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without zone are taken in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("type"), F.col("lang").alias("tag"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("id") == vec_id).select(F.col("v").alias("q"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id"), "ts")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), "ts", "event_type", "value", "props")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations to regions, as a graph of names."""
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    e = lambda d, a, x, b, y, kind: d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("edge_type"))
    return e(c, "C", "c_custkey", "N", "c_nationkey", "lives_in").union(e(s, "S", "s_suppkey", "N", "s_nationkey", "based_in")).union(e(n, "N", "n_nationkey", "R", "n_regionkey", "part_of"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, p, k, name: read(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(name).alias("title"))
    return n("customer", "C", "c_custkey", "c_name").union(n("nation", "N", "n_nationkey", "n_name")).union(n("region", "R", "r_regionkey", "r_name"))


EDGES_SQL = """edges AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'lives_in' AS edge_type FROM customer
 UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'based_in' FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'part_of' FROM nation)"""
NODES_SQL = """nodes AS (SELECT 'C' || c_custkey AS id, c_name AS title FROM customer UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)"""
