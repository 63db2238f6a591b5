"""Distances between array columns, as Column expressions and as SQL functions.

Smaller is nearer for every metric: squared Euclidean, negated inner product, one minus cosine.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Added to norms' product (cosine) and to the squared norm under the root (normalise).
EPSILON = 1e-8


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def as_double(c: Column) -> Column:
    return c.cast("array<double>")


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if the lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def neg_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """A zero vector is at distance 1 from every vector."""
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(EPSILON))


def normalize(v: Column, epsilon: float = EPSILON) -> Column:
    """v over the root of its squared norm plus epsilon."""
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v) + F.lit(epsilon)))


BY_METRIC = {"L2": l2_sq, "InnerProduct": neg_inner_product, "Cosine": cosine_distance}

_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0.0D, (acc, x) -> acc + x)"
_SQL = {
    "l2_sq": _SUM.format("(x - y) * (x - y)"),
    "neg_inner_product": f"-{_SUM.format('x * y')}",
    "cosine_distance": f"1.0D - {_SUM.format('x * y')} / (sqrt({_SUM.format('x * y').replace('zip_with(a, b', 'zip_with(a, a')}) * sqrt({_SUM.format('x * y').replace('zip_with(a, b', 'zip_with(b, b')}) + 1e-8D)",
}


def register(spark: SparkSession) -> None:
    """Make the distances and normalize_vector available to SQL as temporary functions.

    A temporary SQL function cannot stand in ORDER BY: project it first.
    """
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_vector(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(v, x -> x / sqrt(aggregate(v, 0.0D, (acc, y) -> acc + y * y) + 1e-8D))")
