"""Column expressions of linear algebra over named feature columns. All run inside code generation, but for wide distances."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: With more features than this, distances are computed as matrices over Arrow batches rather than as generated sums.
WIDE = 30


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def dot(features, weights, intercept: bool = True) -> Column:
    """weights[0] + features · weights[1:], or features · weights without intercept."""
    parts = [F.col(x) * F.lit(float(w)) for x, w in zip(features, weights[intercept:], strict=True)]
    return total([F.lit(float(weights[0])), *parts] if intercept else parts)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def squared_distance(features, centroid) -> Column:
    return total([(F.col(x) - F.lit(float(c))) * (F.col(x) - F.lit(float(c))) for x, c in zip(features, centroid, strict=True)])


def squared_distances(features, centroids) -> Column:
    """The array of squared distances to each centroid."""
    if len(features) <= WIDE:
        return F.array(*(squared_distance(features, c) for c in centroids))
    c = np.array(centroids, float)

    @F.pandas_udf("array<double>")
    def of(*columns):
        import pandas as pd

        x, out = np.stack([v.to_numpy(dtype=float) for v in columns], axis=1), np.zeros((len(columns[0]), len(c)))
        for i, centre in enumerate(c):
            out[:, i] = ((x - centre) ** 2).sum(axis=1)
        return pd.Series(list(out))

    return of(*map(F.col, features))


def gaussian(features, centroid, sigma: float, halved: bool = True) -> Column:
    """exp(-|x - c|² / (2σ²)), or without the 2."""
    return F.exp(-squared_distance(features, centroid) / F.lit((2.0 if halved else 1.0) * sigma * sigma))


def first_least(columns: list[Column]) -> Column:
    """The index, from 0, of the least column; the first one of equals."""
    values = F.array(*columns)
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def first_greatest(columns: list[Column]) -> Column:
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def hashed_id(column: Column) -> Column:
    """The SHA-256 hex digest of a whole number or text."""
    return F.sha2(column.cast("string"), 256)


def digest(column: Column, how: str) -> Column:
    """md5, or sha256; sha3_512 where no built-in exists goes through an Arrow function."""
    text = column.cast("string")
    if how == "md5":
        return F.md5(text)
    if how == "sha256":
        return F.sha2(text, 256)
    if how == "sha3_512":
        import hashlib

        @F.pandas_udf("string")
        def of(s):
            return s.map(lambda x: None if x is None else hashlib.sha3_512(x.encode()).hexdigest())

        return of(text)
    raise ValueError(how)


def uniform(id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on a whole number and a seed only, by one linear congruential step."""
    size = F.lit(2147483648)
    return F.pmod(F.pmod(id.cast("bigint"), size) * 1103515245 + 12345 + seed * 7919, size) / F.lit(2147483648.0)


def cross_entropy(score: Column, y: Column, eps: float = 1e-6) -> Column:
    o = score * F.lit(1 - 2 * eps) + F.lit(eps)
    return -y * F.log(o) - (F.lit(1.0) - y) * F.log(F.lit(1.0) - o)
