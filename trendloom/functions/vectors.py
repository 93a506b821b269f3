"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Cosine with a floor under the norms, so that a zero vector gives 0."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(least))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def mean_vector(v: Column, size: int) -> Column:
    """Aggregate: the element-wise mean, with one partial sum per element."""
    return F.array(*[F.avg(v[i].cast("double")) for i in range(size)])


_NUMBER = r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def parsed(text: Column) -> Column:
    """The numbers of a vector written as text, in any spelling; null if one is NaN, infinite or null."""
    return F.when(~F.lower(text).rlike("nan|inf|null|none"), F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), 1), lambda x: x.try_cast("float")))
