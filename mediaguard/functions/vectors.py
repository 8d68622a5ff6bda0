"""Dense-vector expressions over ARRAY<DOUBLE>."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2norm(a) -> Column:
    # the norm is bound to a lambda variable: inside the element lambda it would be
    # recomputed for every element
    return F.transform(F.array(norm(a)), lambda n: F.transform(_c(a), lambda e: e / n))[0]


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def measured(a) -> Column:
    """The vector, or null when every entry is zero (nothing was measured)."""
    return F.when(F.exists(_c(a), lambda e: e != 0), _c(a))


def mean_of(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v) / F.size(_c(a))


def argmax_class(x, prototypes: Column, names: list[str]) -> Column:
    """Name of the prototype with the largest dot product; the lowest index wins a tie.

    ``prototypes`` is one array with a fixed number of vectors, so no row is multiplied.
    """
    scored = F.array(*[F.struct(dot(x, prototypes[i]).alias("s"), F.lit(-i).alias("o"),
                                F.lit(n).alias("n")) for i, n in enumerate(names)])
    return F.array_max(scored)["n"]
