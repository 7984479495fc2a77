"""Functions of vector columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Added to a norm before dividing by it, so a zero vector stays one.
EPSILON = 1e-8


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def vector_add(a: Column | str, b: Column | str) -> Column:
    """Sum, element by element."""
    return F.zip_with(a, b, lambda x, y: x + y)


def axpy(factor: float, a: Column | str, b: Column | str) -> Column:
    """factor * a + b, element by element."""
    return F.zip_with(a, b, lambda x, y: F.lit(factor) * x + y)


def l2_normalize(v: Column | str) -> Column:
    """The vector over its norm plus epsilon.

    The norm is bound once by a lambda over a one-element array; written into
    the inner lambda it would be computed again for each element.
    """
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v)) + EPSILON
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def distance_of(similarity: Column | str) -> Column:
    """Squared distance of unit vectors with that dot product."""
    return F.lit(2.0) - F.lit(2.0) * (F.col(similarity) if isinstance(similarity, str) else similarity)


def argmax(v: Column | str) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def subvector(v: Column | str, subspace: Column | int, width: int) -> Column:
    """The ``subspace``-th of the vector's parts of ``width`` elements."""
    s = subspace if isinstance(subspace, Column) else F.lit(subspace)
    return F.slice(v, (s * width + 1).cast("int"), F.lit(width))


def register_sql(spark: SparkSession) -> None:
    """Make ``vec_dot(a, b)`` and ``vec_squared_l2(a, b)`` available to SQL of this session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_squared_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    )
