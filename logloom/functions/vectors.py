"""Vector columns, accumulated in DOUBLE."""

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def _with_value(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once per row and not once per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""

    def scaled(w: Column) -> Column:
        length = F.when(norm(w) == 0, 1.0).otherwise(norm(w))
        return _with_value(length, lambda n: F.transform(w, lambda x: x.cast("double") / n))

    return _with_value(v, scaled)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two unit vectors; rounding noise below zero is cut off."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b))
