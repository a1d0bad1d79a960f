"""Arithmetic of array<double> vectors as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    """Dot product; NULL if a vector is NULL or their lengths differ."""
    sums = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(u) == F.size(v), sums)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def nonzero(v: Column) -> Column:
    """The vector has an element that is not 0; false for NULL."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def usable(v: Column, dim: int) -> Column:
    """A vector of ``dim`` finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~bad


def unit_cosine(u: Column, v: Column) -> Column:
    """Cosine similarity mapped to [0, 1]: (1 + cos) / 2. A zero vector makes it 0.5 (cosine taken as 0)."""
    cosine = F.try_divide(dot(u, v), norm(u) * norm(v))
    return (F.lit(1.0) + F.coalesce(cosine, F.lit(0.0))) / F.lit(2.0)
