"""Vectors held as arrays of doubles: products, cosine, softmax, attention, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column, eps: float = 1e-9) -> Column:
    return F.sqrt(dot(a, a) + eps)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def softmax(values: Column) -> Column:
    peak = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - peak))
    return F.transform(exps, lambda e: e / (total(exps) + 1e-9))


def attention_similarity(tokens: Column, dim: int) -> Column:
    """Similarity of the first token to the softmax-weighted pool of all tokens, in [-1, 1].

    The pool is linear, so its product with the first token is the weighted sum of the products.
    """
    scale = 1.0 / dim ** 0.5
    first = F.get(tokens, F.lit(0))
    products = F.transform(tokens, lambda t: dot(first, t) * scale)
    pooled = total(F.zip_with(softmax(products), products, lambda w, p: w * p))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pooled))


def attention_boost(similarity: Column) -> Column:
    return 0.05 * F.greatest(F.lit(0.0), similarity)


def entropy_of_counts(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits of an array of counts adding up to `n`."""
    return F.aggregate(
        counts, F.lit(0.0),
        lambda h, c: h - F.when(c > 0, (c / n) * F.log2(c / n)).otherwise(0.0),
    )
