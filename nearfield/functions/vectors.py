"""Vector expressions as Columns over ``array<float>``; all arithmetic is in double, left to right.

Every expression is built from Spark's own array functions, so it stays in the JVM and can be
pushed, pruned and reordered by Catalyst like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to each norm in cosine distances and in :func:`normalize`.
EPSILON = 1e-10
#: Least divisor of :func:`normalize_rows`.
FLOOR = 1e-12


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(_double(v), lambda x: x * x))


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def dot(a: Column, b: Column) -> Column:
    """Inner product; larger is nearer."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (no root)."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def squared_l2_by_norms(a: Column, b: Column) -> Column:
    """The same from norms and an inner product, for where norms are already columns."""
    return squared_norm(a) - 2.0 * dot(a, b) + squared_norm(b)


def _divided(v: Column, by: Column) -> Column:
    """Each component by a number that is computed once a vector: in the lambda itself it would be for each component."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(_double(v), lambda x: x / n)), 0)


def normalize(v: Column) -> Column:
    """Scale to length 1, with an epsilon added to the norm; zero stays zero."""
    return _divided(v, norm(v) + EPSILON)


def normalize_rows(v: Column) -> Column:
    """Scale to length 1, dividing by at least ``FLOOR``."""
    return _divided(v, F.greatest(norm(v), F.lit(FLOOR)))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; 1 if either vector is zero."""
    return unit_cosine_distance(normalize(a), normalize(b))


def unit_cosine_distance(a: Column, b: Column) -> Column:
    """The same of vectors that :func:`normalize` has scaled."""
    return 1.0 - dot(a, b)


def distance(a: Column, b: Column, metric: str) -> Column:
    """What a search with this metric minimises."""
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError("metric must be 'cosine', 'l2' or 'dot'")


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(_double(v), _double(centroid), lambda x, c: x - c)


def split(v: Column, parts: int, width: int) -> Column:
    """Sub-vectors: ``parts`` arrays of ``width`` components."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda s: F.slice(v, s * width + 1, F.lit(width)))


def decode(codes: Column, codebooks: Column) -> Column:
    """Join the centroids that codes stand for; ``codebooks`` is subspace, code, component."""
    return F.flatten(F.transform(codes, lambda c, s: F.get(F.get(codebooks, s), c.cast("int"))))


def table_distance(codes: Column, table: Column) -> Column:
    """Sum of a distance table's (subspace, code) entries at the codes."""
    return _sum(F.zip_with(codes, table, lambda c, t: F.get(t, c.cast("int"))))


def boundary_margin(first: Column, second: Column) -> Column:
    """How much farther the second nearest centroid is, relative to the nearest."""
    return (second - first) / F.greatest(F.abs(first), F.lit(1e-6))


def has_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error that stops the job if its size is not ``dim``."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), F.size(v).cast("string"))))
