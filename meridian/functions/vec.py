"""Vector expressions over array<double> columns; all JVM-side higher-order functions.

An argument that is used twice should be a column, not a long expression: assign it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with value computed once a row.

    A lambda that names a column may have that column's expression put in its place and then work it
    out again for every element; a bound variable can't.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(u, v) -> Column:
    return total(F.zip_with(_c(u), _c(v), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v, k) -> Column:
    return let(_k(k), lambda c: F.transform(_c(v), lambda x: x * c))


def added(u, v, k=1.0) -> Column:
    """u + k v."""
    return let(_k(k), lambda c: F.zip_with(_c(u), _c(v), lambda x, y: x + c * y))


def _k(k):
    return k if isinstance(k, Column) else F.lit(k)


def normalised(df: DataFrame, name: str, v) -> DataFrame:
    """Adds name = v / max(norm, 1e-12)."""
    return df.withColumn(name, let(_c(v), lambda a: let(F.greatest(norm(a), F.lit(EPS)), lambda n: F.transform(a, lambda x: x / n))))


def truncated(df: DataFrame, name: str, v, dim: int | Column) -> DataFrame:
    """The leading dim numbers, of unit length again."""
    return normalised(df, name, F.slice(_c(v), 1, dim))


def sqdist(u, v) -> Column:
    return total(F.zip_with(_c(u), _c(v), lambda x, y: (x - y) * (x - y)))


def euclid(u, v) -> Column:
    return F.sqrt(sqdist(u, v))


def angular(u, v) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v))))


def poincare(u, v, max_sq: float = 1 - 1e-9, min_arg: float = 1.0, min_den: float = 0.0) -> Column:
    """Poincare distance; squared norms are cut at max_sq, the argument at min_arg, the denominator at min_den."""
    den = (1 - F.least(dot(u, u), F.lit(max_sq))) * (1 - F.least(dot(v, v), F.lit(max_sq)))
    arg = 1 + 2 * sqdist(u, v) / F.greatest(den, F.lit(min_den)) if min_den else 1 + 2 * sqdist(u, v) / den
    return F.acosh(F.greatest(arg, F.lit(min_arg)))


def formula_score(dist, q_sq, d_sq) -> Column:
    """-ln(x + sqrt(x^2 - 1)): the negated Poincare distance from a Euclidean one and squared norms."""
    x = 1 + 2 * _c(dist) * _c(dist) / ((1 - _c(q_sq)) * (1 - _c(d_sq)))
    return -F.ln(x + F.sqrt(F.greatest(x * x - 1, F.lit(0.0))))


def radius(n) -> Column:
    """Hyperbolic radius of a point with Euclidean norm n."""
    return 2 * F.atanh(F.least(_c(n), F.lit(1 - EPS)))


def clamped(v) -> Column:
    """The point, moved into the open ball if need be."""
    return scaled(v, F.least(F.lit(1.0), F.lit(1 - 1e-6) / F.greatest(norm(v), F.lit(EPS))))


def mobius_add(df: DataFrame, name: str, u: str, v: str) -> DataFrame:
    uv, uu, vv = dot(u, v), dot(u, u), dot(v, v)
    k = F.struct(uv.alias("uv"), uu.alias("uu"), vv.alias("vv"))

    def both(k):
        den = F.greatest(1 + 2 * k["uv"] + k["uu"] * k["vv"], F.lit(EPS))
        return let(F.struct(((1 + 2 * k["uv"] + k["vv"]) / den).alias("a"), ((1 - k["uu"]) / den).alias("b")), lambda c: F.zip_with(u, v, lambda x, y: c["a"] * x + c["b"] * y))

    return df.withColumn(name, let(k, both))


def mobius_scale(df: DataFrame, name: str, t, x: str) -> DataFrame:
    def factor(n):
        return F.when(n < EPS, F.lit(0.0)).otherwise(F.tanh(_c(t) * F.atanh(F.least(n, F.lit(1 - EPS)))) / n)

    return df.withColumn(name, scaled(x, let(norm(x), factor)))


def geodesic(df: DataFrame, name: str, u: str, v: str, steps: int = 64) -> DataFrame:
    """steps rows for each row: step, and the point of the geodesic from u to v."""
    d = mobius_add(df.withColumn("_m", scaled(u, F.lit(-1.0))), "_w", "_m", v)
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    d = mobius_scale(d, "_p", F.col("step") / (steps - 1.0), "_w")
    return mobius_add(d, name, u, "_p").drop("_m", "_w", "_p")


def warped(df: DataFrame, v: str, r_max) -> DataFrame:
    """x, y: the point drawn at its hyperbolic radius, relative to r_max."""
    d = df.withColumn("_n", F.least(norm(v), F.lit(1 - EPS)))
    k = F.when(F.col("_n") < EPS, F.lit(0.0)).otherwise(F.least(2 * F.atanh("_n") / _k(r_max), F.lit(1.0)) / F.col("_n"))
    return d.withColumn("_k", k).withColumns({"x": F.get(v, F.lit(0)) * F.col("_k"), "y": F.get(v, F.lit(1)) * F.col("_k")}).drop("_n", "_k")


def geodesic_shift(df: DataFrame, name: str, v: str, off: str, alpha) -> DataFrame:
    """v moved along the sphere against the offset's tangent part."""

    def tangent(vo):
        return F.zip_with(off, v, lambda o, x: vo * x - o)

    def move(t):
        return let(F.greatest(norm(t), F.lit(EPS)), lambda n: F.zip_with(v, t, lambda x, y: F.cos(_k(alpha) * n) * x + F.sin(_k(alpha) * n) * y / n))

    return df.withColumn(name, let(let(dot(v, off), tangent), move))


def exp0(v, curvature: float = 1.0) -> Column:
    """A unit vector mapped into the ball of a curvature at the origin."""
    import math

    k = math.tanh(math.sqrt(curvature)) / math.sqrt(curvature)
    return scaled(v, F.lit(k))
