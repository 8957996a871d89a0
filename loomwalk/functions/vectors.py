"""Functions of vectors and scores: columns in, columns out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def squareplus(x: Column) -> Column:
    return (x + F.sqrt(x * x + 4)) / 2


def affine(mean: Column, variance: Column, loc: Column, scale: Column) -> tuple[Column, Column, Column]:
    """(mean, variance, standard deviation) of a distribution after ``loc + scale * x``."""
    v = variance * scale * scale
    return mean * scale + loc, v, F.sqrt(v)


def entailment(contradiction: Column, entails: Column) -> Column:
    """The probability of entailment against contradiction."""
    return sigmoid(entails - contradiction)


def gumbel_key(logit: Column, temperature: float, seed: int) -> Column:
    """A sort key: the largest of a group is a sample from the softmax of its logits."""
    u = F.rand(seed)
    return logit / max(temperature, 1e-10) - F.log(-F.log(F.greatest(u, F.lit(1e-20))))


def keep_top_k(a: Column, share: float) -> Column:
    """All but the ``max(int((1 - share) * n), 1)`` largest become null."""
    k = F.greatest(F.floor((1 - F.lit(share)) * F.size(a)).cast("int"), F.lit(1))
    least = F.element_at(F.array_sort(a, lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)), k)
    return F.transform(a, lambda x: F.when(x >= least, x))


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


LN10 = math.log(10)
