"""Distances of two factor vectors (arrays of equal length) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(p: Column, q: Column) -> Column:
    return _sum(F.zip_with(p, q, lambda a, b: a * b))


def jaccard(p: Column, q: Column) -> Column:
    """Tanimoto: 1 - p.q / (p.p + q.q - p.q)."""
    return 1 - dot(p, q) / (dot(p, p) + dot(q, q) - dot(p, q))


def euclidean(p: Column, q: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(p, q, lambda a, b: (a - b) * (a - b))))


def manhattan(p: Column, q: Column) -> Column:
    """The root of the summed differences."""
    return F.sqrt(_sum(F.zip_with(p, q, lambda a, b: F.abs(a - b))))


def hamming(p: Column, q: Column) -> Column:
    return _sum(F.zip_with(p, q, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))


def kullback(p: Column, q: Column) -> Column:
    """sum(p) * ln(sum(p / q))."""
    return _sum(p) * F.log(_sum(F.zip_with(p, q, lambda a, b: a / b)))


def cosine(p: Column, q: Column) -> Column:
    return 1 - dot(p, q) / (F.sqrt(dot(p, p)) * F.sqrt(dot(q, q)))


METRICS = {"jaccard": jaccard, "euclidean": euclidean, "manhattan": manhattan, "hamming": hamming, "kl": kullback, "cosine": cosine}
