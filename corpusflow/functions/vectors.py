"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """V1: clamped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def normalise(v: Column) -> Column:
    """V1: unit length, in doubles. The vector and its length are worked out once, not for each of its values."""

    def scaled(own: Column) -> Column:
        return F.zip_with(own, F.array_repeat(norm(own), F.size(own)), lambda x, n: x.cast("double") / n)

    return F.get(F.transform(F.array(v), scaled), F.lit(0))


def vector_faults(v: Column, dim: int) -> Column:
    """The rules that a vector breaks: null, dimension, not_finite, zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.array_compact(
        F.array(
            F.when(v.isNull(), "null"),
            F.when(v.isNotNull() & (F.size(v) != dim), "dimension"),
            F.when(~finite, "not_finite"),
            F.when(finite & ~F.exists(v, lambda x: x != 0), "zero"),
        )
    )


def hash_vector(text: Column, dim: int) -> Column:
    """Bytes of sha256("block:text") for blocks 0, 1, ..., each byte / 127.5 - 1.

    A text is hashed once for each block of 32 values: the digests are the rows of an array, and its values their bytes.
    """
    blocks = -(-dim // 32)
    digests = F.array(*(F.sha2(F.concat(F.lit(f"{k}:"), text), 256) for k in range(blocks)))
    number = lambda h, i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("double") / 127.5 - 1
    return F.slice(F.flatten(F.transform(digests, lambda h: F.array(*(number(h, i) for i in range(32))))), 1, dim)
