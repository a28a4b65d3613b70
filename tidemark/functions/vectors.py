"""Vectors and distributions as arrays (V1-V16). Native higher-order expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used (a lambda would compute it for each element)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; of arrays of two lengths, null."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, missing: float | None = None) -> Column:
    """Cosine; a zero or missing vector gives ``missing``."""
    size = norm(a) * norm(b)
    out = F.when(size > 0, dot(a, b) / size)
    return out if missing is None else F.coalesce(out, F.lit(float(missing)))


def rescaled(similarity: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return (similarity + 1) / 2


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return let(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(v.cast("array<double>")))


def share(v: Column) -> Column:
    """Scaled to sum 1; null where the sum is 0."""
    return let(total(v), lambda size: F.when(size != 0, F.transform(v, lambda x: x.cast("double") / size)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def or_zeros(v: Column, n: int) -> Column:
    """Missing or invalid vectors become zeros."""
    bad = v.isNull() | (F.size(v) != n) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(True)), zeros(n)).otherwise(v.cast("array<double>"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def softmax(v: Column) -> Column:
    return share(let(F.array_max(v).cast("double"), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top))))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence, natural; terms with p = 0 count nothing."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0))))


def js(p: Column, q: Column, base: float = math.e, sentinel: float | None = None) -> Column:
    """V6: Jensen-Shannon distance, the root of the divergence. Inputs are scaled to sum 1; a zero vector gives
    null, or ``sentinel``."""

    def distance(a: Column, b: Column) -> Column:
        half = lambda x: total(F.zip_with(x, F.zip_with(a, b, lambda s, t: (s + t) / 2), lambda s, m: F.when(s > 0, s * F.ln(s / m)).otherwise(F.lit(0.0))))
        return F.when(a.isNotNull() & b.isNotNull(), F.sqrt(F.greatest((half(a) + half(b)) / 2, F.lit(0.0)) / math.log(base)))

    out = let(share(p), lambda a: let(share(q), lambda b: distance(a, b)))
    return out if sentinel is None else F.coalesce(out, F.lit(float(sentinel)))


def multi_hot(codes: Column, size: int) -> Column:
    """Codes as an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.array_contains(codes, i), F.lit(False)).cast("int"))


def above(scores: Column, names: list[str], threshold: float = 0.5) -> Column:
    """Names of the scores that are above the threshold."""
    return F.filter(F.zip_with(scores, F.array(*[F.lit(n) for n in names]), lambda s, n: F.when(s > threshold, n)), lambda n: n.isNotNull())


def wasserstein(a: Column, b: Column) -> Column:
    """V6: one-dimensional Wasserstein distance of two samples: the area between their distribution functions."""
    cuts = F.array_sort(F.array_distinct(F.concat(a, b)))
    at = lambda s, x: F.size(F.filter(s, lambda y: y <= x)) / F.size(s)
    steps = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.abs(at(a, F.element_at(cuts, i)) - at(b, F.element_at(cuts, i))) * (F.element_at(cuts, i + 1) - F.element_at(cuts, i)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None).cast("double")).when(F.size(cuts) == 1, F.lit(0.0)).otherwise(total(steps))
