"""Vector arithmetic on ``array<float>`` columns, in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this are taken as zero: such vectors stay as they are.
EPSILON = 1.1920929e-07


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector]) if len(vector) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The sum of products over the shorter of the two, in DOUBLE; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def exact_dot(a: Column, length: Column, b: Column, b_length: Column) -> Column:
    """As ``dot``, of vectors at length one that were whole numbers of these lengths: their exact sum over both lengths.

    Vectors of no length score zero; where a length is null, this is ``dot``.
    """
    whole = F.zip_with(a, b, lambda x, y: F.coalesce(F.rint(x.cast("double") * length) * F.rint(y.cast("double") * b_length), F.lit(0.0)))
    total = F.aggregate(whole, F.lit(0.0), lambda total, x: total + x)
    known = length.isNotNull() & b_length.isNotNull()
    return F.when(~known, dot(a, b)).when((length > 0) & (b_length > 0), total / length / b_length).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """The vector at length one, as floats."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > EPSILON, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>")))[0].cast("array<float>")


def cosine(a: Column, b: Column) -> Column:
    """For vectors of any length; zero if either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))
