"""Column expressions over ARRAY<DOUBLE> vectors and numeric helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda would be evaluated for every element once the
    optimizer merges projections; the argument of a one-element transform is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def add_scaled(a: Column, b: Column, scale: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + scale * y)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clip_probability(c: Column, eps: float = 1e-7) -> Column:
    return clip(c, eps, 1.0 - eps)


def sigmoid(c: Column) -> Column:
    """Logistic function without overflow on either side."""
    small = F.exp(-F.abs(c))
    return F.when(c >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def softmax_within(rows: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """Adds ``name``, the max-shifted softmax of ``score`` within ``keys``, by two pre-aggregated sums that are joined back."""
    top = rows.groupBy(*keys).agg(F.max(score).alias("_top"))
    raised = rows.join(top, list(keys)).withColumn("_raised", F.exp(F.col(score) - F.col("_top")))
    total = raised.groupBy(*keys).agg(F.sum("_raised").alias("_total"))
    return raised.join(total, list(keys)).withColumn(name, F.col("_raised") / F.col("_total")).drop("_top", "_raised", "_total")


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array."""
    shifted = let(F.array_max(scores), lambda m: F.transform(scores, lambda x: F.exp(x - m)))
    return let(
        shifted,
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)),
    )


def weighted_sum(weights: Column, vecs: Column, zero: Column) -> Column:
    """Sum of ``weights[k] * vecs[k]``, starting from ``zero``."""
    terms = F.arrays_zip(weights.alias("w"), vecs.alias("v"))
    return F.aggregate(terms, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + x["w"] * b))


def zeros_like(a: Column) -> Column:
    return F.transform(a, lambda _: F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard, 0 when either side is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def irf(theta: Column, a: Column, b: Column, c: Column | float = 0.0, scale: float = 1.702) -> Column:
    """Three-parameter logistic item response."""
    guess = c if isinstance(c, Column) else F.lit(float(c))
    return guess + (1 - guess) / (1 + F.exp(-scale * a * (theta - b)))


def mirf(theta: Column, a: Column, b: Column) -> Column:
    """Multidimensional two-parameter item response over array columns."""
    return 1 / (1 + F.exp(-dot(a, theta) + b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of arrays already free of repeats: one set operation instead of two."""
    return let(
        F.size(F.array_intersect(a, b)), lambda both: F.when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))
    )
