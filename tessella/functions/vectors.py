"""Vector arithmetic on array columns, computed in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """Unit vector; vectors shorter than 1e-10 stay as they are."""
    doubles = v.cast("array<double>")
    # The norm is an array of its own: inside the lambda it would be computed for each element.
    norms = F.array_repeat(l2_norm(doubles), F.size(doubles))
    return F.zip_with(doubles, norms, lambda x, n: F.when(n < 1e-10, x).otherwise(x / n))


def cosine(v: Column, unit: list[float]) -> Column:
    """Dot product of a unit vector, given as values, and the unit vector of `v`: one pass for each of product and norm."""
    norm = l2_norm(v)
    return dot(v, F.lit(unit)) / F.when(norm < 1e-10, 1.0).otherwise(norm)


def unit(values: list[float]) -> list[float]:
    """A query's values scaled to length one; shorter than 1e-10 they stay as they are."""
    norm = math.sqrt(sum(x * x for x in values))
    return [float(x) / norm if norm >= 1e-10 else float(x) for x in values]
