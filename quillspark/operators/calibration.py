"""Noise floors of collections: measured, kept by key, and resolved against defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp_sigma
from . import retrieval as R

# The version of the probes, what a measure must rest on, the mean from which a collection is tight, defaults by length.
PROBES_VERSION, MIN_NOTES, MIN_PAIRS, TIGHT = 1, 30, 100, 0.58
DEFAULT_FLOOR = {1024: 0.45, 384: 0.0}
DEFAULT_SIGMA = {1024: 0.073, 384: 0.0}


def by_length(dims: Column, values: dict[int, float]) -> Column:
    return F.coalesce(*[F.when(dims == k, F.lit(float(v))) for k, v in values.items()], F.lit(0.0))


def measured(vectors: DataFrame, probes: DataFrame, key: str, created_at: str, label: str | None = None) -> DataFrame:
    """One snapshot (key, created_at, embedder, dims, notes, noise_floor, probes, probes_version, mu, sigma, pairs) of vectors (id, v), or no row.

    probes: (p), a few. There is none without vectors, or if vectors and probes aren't all of one length. The floor is the greatest
    cosine of a vector and a probe, 0 at least; mean and deviation are those of R.pair_spread, 0 for fewer than two vectors."""
    lengths = vectors.select(F.size("v").alias("dims")).union(probes.select(F.size("p")))
    shape = lengths.agg(F.min("dims").alias("dims"), F.max("dims").alias("most")).filter("dims = most and dims > 0").select("dims")
    counts = vectors.agg(F.count("*").alias("notes")).filter("notes > 0").crossJoin(probes.agg(F.count("*").alias("probes")))
    row = shape.crossJoin(counts).crossJoin(R.noise_floor(vectors, probes)).crossJoin(R.pair_spread(vectors))  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return row.select(
        F.lit(key).alias("key"), F.lit(created_at).alias("created_at"), F.lit(label).cast("string").alias("embedder"), "dims", "notes",
        F.greatest(F.coalesce("noise_floor", F.lit(0.0)), F.lit(0.0)).alias("noise_floor"), "probes", F.lit(PROBES_VERSION).alias("probes_version"), zero("mu"), zero("sigma"), F.col("n_pairs").alias("pairs"),
    )


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each key by (created_at, seq); seq is the order in which they were stored."""
    columns = [c for c in snapshots.columns if c != "key"]
    return snapshots.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("created_at", "seq")).alias("s")).select("key", "s.*")


def due(collections: DataFrame, newest: DataFrame) -> DataFrame:
    """Collections (key, embedded, deleted) to be measured again: changed ones, and those without a snapshot of these probes."""
    current = newest.filter(F.col("probes_version") == PROBES_VERSION).select("key", F.lit(True).alias("current"))
    return collections.join(current, "key", "left").filter("coalesce(embedded, 0) > 0 or coalesce(deleted, 0) > 0 or current is null").select("key")


def resolved(collections: DataFrame, newest: DataFrame) -> DataFrame:
    """(key, noise_floor, sigma, tight, measured) of collections (key, dims): the newest snapshot's if it rests on enough notes and pairs, else the length's defaults.

    sigma is clamped; only a measured collection is tight. newest: what latest() gives, one row for each key."""
    enough = newest.filter((F.col("notes") >= MIN_NOTES) & (F.col("pairs") >= MIN_PAIRS)).select("key", F.col("noise_floor").alias("floor"), F.col("sigma").alias("own"), "mu", F.lit(True).alias("m"))
    rows = collections.join(enough, "key", "left")
    pick = lambda own, default: F.when(F.col("m"), F.col(own)).otherwise(by_length(F.col("dims"), default))
    return rows.select("key", pick("floor", DEFAULT_FLOOR).alias("noise_floor"), clamp_sigma(pick("own", DEFAULT_SIGMA)).alias("sigma"), F.coalesce(F.col("m") & (F.col("mu") >= TIGHT), F.lit(False)).alias("tight"), F.coalesce("m", F.lit(False)).alias("measured"))
