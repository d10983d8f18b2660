"""Column functions on vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; 0 if either is (nearly) zero."""
    both = norm(a) * norm(b)
    return F.when((norm(a) < 1e-10) | (norm(b) < 1e-10), 0.0).otherwise(dot(a, b) / both)


def triple_factor(sim: Column) -> Column:
    """How much a relation's similarity to the query scales a neighbour's score: 0.6 to 1.4, 1 at similarity 0.5."""
    return F.greatest(F.lit(0.6), F.least(F.lit(1.4), F.coalesce(sim, F.lit(0.5)) + 0.5))


def tag_boost(score: Column, tags: Column, query: Column) -> Column:
    """A tenth more for each tag among the query's tokens, three tenths at most."""
    matches = F.size(F.filter(tags, lambda t: F.array_contains(query, t)))
    return score * (1 + F.least(matches * 0.1, F.lit(0.3)))
