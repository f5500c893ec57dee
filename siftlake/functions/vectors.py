"""Vector columns: norms, products and scores of vectors that are there already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often lambdas in ``f`` use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero."""
    return bind(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def clip_score(image: Column, caption: Column) -> Column:
    """Cosine of two embeddings."""
    return dot(normalise(image), normalise(caption)).cast("float")


def aesthetic(embedding: Column, weights: list[float], bias: float) -> Column:
    """An affine head on the normalised embedding: layers without a non-linearity collapse to one."""
    return (dot(normalise(embedding), F.array(*[F.lit(float(w)) for w in weights])) + bias).cast("float")


def resolution(width: Column, height: Column) -> Column:
    return F.least(width, height).cast("int")
