"""Vector and scoring functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def chunks(a: Column, n: int, size: int) -> Column:
    """n vectors of size elements of one long vector."""
    return F.array(*[F.slice(a, i * size + 1, size) for i in range(n)])


def maxsim(query: Column, doc: Column) -> Column:
    """The sum over query vectors of their best dot product; one that is no better than -1 counts 0."""

    def best(q: Column) -> Column:
        top = F.array_max(F.transform(doc, lambda d: dot(q, d)))
        return F.when(top > -1, top).otherwise(0.0)

    return F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, v: s + v)


def minmax(x: Column, window) -> Column:
    low, high = F.min(x).over(window), F.max(x).over(window)
    return F.when(high > low, (x - low) / (high - low)).otherwise(1.0)


def retrieval_strength(hours: Column, decay: float = 0.5) -> Column:
    """An aggregate: ln of the sum of hours ** -decay, elapsed time no less than a second."""
    return F.log(F.sum(F.pow(F.when(hours <= 0, 1 / 3600).otherwise(hours), F.lit(-decay))))


def combined(retrieval: Column, storage: Column, similarity: Column | float = 0.0, alpha: float = 0.6, beta: float = 0.4, delta: float = 0.0) -> Column:
    return alpha * retrieval + beta * storage + delta * (F.lit(similarity) if isinstance(similarity, float) else similarity)


def clamp_sigma(sigma: Column) -> Column:
    return F.when(sigma.isNull() | F.isnan(sigma), 0.03).otherwise(F.greatest(F.lit(0.03), F.least(F.lit(0.12), sigma)))


def relevance(top: Column, noise: Column, sigma: Column, default_noise: float) -> Column:
    """z and label of a query's best cosine against the collection's noise floor; a z that is no number is 0 and no match."""
    cutoff, raw = F.least(noise - 0.5 * sigma, F.lit(default_noise)), F.try_divide(top - noise, sigma)
    number = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    z = F.when(number, raw).otherwise(0.0)
    label = F.when(~number | (top <= cutoff), "no_match").when(z <= 1.0, "weak").when(z <= 2.5, "moderate").otherwise("strong")
    return F.struct(z.alias("z"), label.alias("label"))


# The order of confidences.
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}


def edge_priority(edge_type: Column, confidence: Column) -> Column:
    """0 for explicit relations, 1 for explicit links and embeds, 2 for medium confidence, 3 for all else."""
    return F.when(edge_type == "explicit_relation", 0).when(edge_type.isin("explicit_link", "explicit_embed"), 1).when(confidence == "medium", 2).otherwise(3)


def meets_confidence(edge: Column, least: str) -> Column:
    """False for unknown labels on either side."""
    rank = F.coalesce(*[F.when(edge == k, v) for k, v in CONFIDENCE.items()], F.lit(0))
    return (rank >= CONFIDENCE[least]) & (rank > 0) if least in CONFIDENCE else F.lit(False)
