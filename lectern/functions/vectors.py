"""Vector functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def fit_vector(v: Column, dims: int) -> Column:
    """The first ``dims`` components at unit length; a zero vector stays; too short a one fails."""
    cut = F.slice(doubles(v), 1, dims)
    n = norm(cut)
    return F.when(F.size(v) < dims, F.raise_error(F.lit("vector too short"))).when(n == 0, cut).otherwise(F.transform(cut, lambda x: x / n))


def stub_vector(text: Column, dims: int) -> Column:
    """A deterministic unit vector from the text's SHA-256: an offline embedder."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return F.transform(raw, lambda x: x / norm(raw))
