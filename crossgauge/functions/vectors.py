"""Vector expressions over arrays; products are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def argmax(a: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def salience_share(salience: Column, span: Column) -> Column:
    """The span's part of the total; 0 when the total isn't positive."""
    total = F.aggregate(salience, F.lit(0.0), lambda s, v: s + v)
    part = F.aggregate(F.transform(span, lambda i: F.coalesce(F.get(salience, i), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, part / total).otherwise(0.0)
