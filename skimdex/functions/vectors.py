"""Vector columns and similarity scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: score bands ---
HIGH_BAND = 0.8
MEDIUM_BAND = 0.6
# --- end of fixed values ---


def fit_vector_dim(vector: Column, dim: int) -> Column:
    """Zero-pad or cut a vector to ``dim`` entries."""
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(vector), F.lit(0)))
    return F.slice(F.concat(vector, pad), 1, dim)


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vector columns; null for zero, NaN or differently sized vectors."""
    cos = dot(left, right) / F.nullif(F.sqrt(dot(left, left) * dot(right, right)), F.lit(0.0))
    return F.when((F.size(left) == F.size(right)) & ~F.isnan(cos), cos)


def distance_to_score(distance: Column) -> Column:
    """Cosine distance to a score in [0, 1], higher is closer."""
    return F.least(F.greatest(F.lit(1.0) - distance, F.lit(0.0)), F.lit(1.0))


def similarity_percent(score: Column) -> Column:
    """Score as a percentage with two decimals."""
    return F.round(score * 100.0, 2)


def similarity_band(score: Column) -> Column:
    """``high``, ``medium`` or ``low`` for a score in [0, 1]."""
    return F.when(score >= HIGH_BAND, "high").when(score >= MEDIUM_BAND, "medium").otherwise("low")
