"""Vectors as arrays of floats, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def vec_valid(v: Column) -> Column:
    """v, or null if it is missing, empty, holds NaN or null, or has no length."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.when(v.isNotNull() & ~bad & (norm(v) > 0), v)


def vec_normalize(v: Column) -> Column:
    """v of length 1; null where v isn't valid."""
    ok = doubles(vec_valid(v))
    return F.element_at(F.transform(F.array(F.struct(ok.alias("v"), norm(ok).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 where either is null or has no length."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(-1.0))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors that vec_normalize has made; -1 where either is null."""
    return F.coalesce(dot(a, b), F.lit(-1.0))
