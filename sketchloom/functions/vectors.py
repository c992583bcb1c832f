"""Functions of numeric array columns: products, norms, kernels and distances, summed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Product = Callable[[Column, Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for empty arrays, null if the lengths differ or an element is null."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; null for the zero vector. The norm is bound once, not computed again for each element."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))), F.lit(0))


def self_prod(v: Column, prod: Product = dot) -> Column:
    return prod(v, v)


def induced_dist(a: Column, b: Column, prod: Product = dot) -> Column:
    """The distance that an inner product induces."""
    p = prod(a, b)
    return F.sqrt(F.greatest(F.lit(0.0), prod(a, a) + prod(b, b) - p - p))


def cos_sim(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(F.greatest(F.lit(0.0), dot(a, a) * dot(b, b))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cos_sim(a, b)


def rbf(bandwidth: float) -> Product:
    return lambda a, b: F.exp(-_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))) / F.lit(float(bandwidth)))


def mahalanobis(inv_cov: list[list[float]]) -> Product:
    """The full bilinear form of the inverse covariance."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in inv_cov])
    return lambda a, b: dot(a, F.transform(rows, lambda r: dot(r, b)))


def poly(scale: float, bias: float, degree: float) -> Product:
    return lambda a, b: F.pow(F.lit(float(scale)) * dot(a, b) + F.lit(float(bias)), F.lit(float(degree)))


def sigmoid(scale: float, bias: float) -> Product:
    return lambda a, b: F.tanh(F.lit(float(scale)) * dot(a, b) + F.lit(float(bias)))


def induced_product(dist: Product, zero: Column) -> Product:
    """The inner product that a distance induces; `zero` is the origin."""
    return lambda a, b: (F.pow(dist(zero, a), F.lit(2.0)) + F.pow(dist(zero, b), F.lit(2.0)) - F.pow(dist(a, b), F.lit(2.0))) / 2.0


def zip_prods(left, right, a: str, b: str, on: str, prod: Product = dot, name: str = "prod"):
    """Row by row: equi-join of two tables on an id."""
    r = right.select(F.col(on), F.col(b).alias("__b"))
    return left.select(F.col(on), F.col(a).alias("__a")).join(r, on).select(on, prod(F.col("__a"), F.col("__b")).alias(name))


def cross_prods(left, right, left_id: str, right_id: str, a: str, b: str, prod: Product = dot, name: str = "prod"):
    """All pairs, as the operator asks for: (left_id, right_id, product). The optimizer broadcasts the smaller side if its size allows."""
    x = left.select(F.col(left_id).alias("left_id"), F.col(a).alias("__a"))
    y = right.select(F.col(right_id).alias("right_id"), F.col(b).alias("__b"))
    return x.crossJoin(y).select("left_id", "right_id", prod(F.col("__a"), F.col("__b")).alias(name))
