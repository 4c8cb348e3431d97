"""Vector similarity as JVM expressions over arrays; double precision on both sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """0.0 for null, empty, zero or unequally long vectors."""
    na, nb = norm(a), norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    c = dot(a, b) / (na * nb)
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) if clamp else c
    return F.when(ok, c).otherwise(F.lit(0.0))


def filled(a: Column) -> Column:
    """An empty vector is no vector."""
    return F.when(F.size(a) > 0, a)
