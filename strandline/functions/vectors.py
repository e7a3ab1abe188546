"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """A unit vector; the elements of a zero vector become null."""
    return F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.try_divide(x, s["n"])))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, not below 0; null for a zero vector."""
    return F.greatest(F.lit(0.0), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def sigmoid(x: Column) -> Column:
    """The probability of a logit."""
    return 1 / (1 + F.exp(-x))


def softmax(values: Column) -> Column:
    """Probabilities of logits, taken from their largest so that none overflows; an empty array stays empty."""
    shares = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(F.array(shares), lambda s: F.transform(s, lambda x: x / total(s)))[0]


def mean_vector(rows: Column) -> Column:
    """The mean of an array of vectors of one length; null for none."""
    summed = F.reduce(F.slice(rows, 2, F.size(rows)), F.get(rows, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(rows))


def listed(values: Column, kind: str) -> Column:
    """An array that may be missing, as an array."""
    return F.coalesce(values, F.array().cast(f"array<{kind}>"))
