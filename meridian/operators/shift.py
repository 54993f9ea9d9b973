"""Aligned pairs, per-language offsets, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V


def first_of(docs: DataFrame) -> DataFrame:
    """The first document of each concept and language."""
    return docs.groupBy("concept", "lang").agg(F.min("id").alias("id"))


def pairs(docs: DataFrame, pivot: str) -> DataFrame:
    """lang, a, b: first documents of a concept in a language and in the pivot."""
    first = first_of(docs)
    p = first.where(F.col("lang") == pivot).select("concept", F.col("id").alias("b"))
    return first.where(F.col("lang") != pivot).join(p, "concept").select("concept", "lang", F.col("id").alias("a"), "b")


def offsets(docs: DataFrame, pivot: str, vec: str = "vec", aligned: DataFrame | None = None) -> DataFrame:
    """lang, off: the mean difference of aligned pairs; a language without a pair has no row."""
    p = pairs(docs, pivot) if aligned is None else aligned
    v = docs.select(F.col("id"), F.col(vec).alias("v"))
    d = p.join(v.withColumnRenamed("v", "va"), p.a == v.id).drop("id").join(v.withColumnRenamed("v", "vb"), p.b == v.id)
    d = d.select("lang", F.posexplode(V.added("va", "vb", -1.0)).alias("pos", "x"))
    m = d.groupBy("lang", "pos").agg(F.avg("x").alias("m"))
    return m.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda z: z["m"]).alias("off"))


def apply(docs: DataFrame, offs: DataFrame, alpha, vec: str = "vec", renormalise: bool = True, cut: bool = False) -> DataFrame:
    """vec - alpha off, of unit length; rows without an offset stay as they are.

    cut: the offset is cut to the length of each row's vector, without renormalising it.
    """
    d = docs.join(F.broadcast(offs.select("lang", "off")), "lang", "left")  # a row a language
    d = d.withColumn("off", F.slice("off", 1, F.size(vec))) if cut else d
    a = alpha if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    moved = V.added(vec, "off", -a)
    d = V.normalised(d, "_moved", moved) if renormalise else d.withColumn("_moved", moved)
    return d.withColumn(vec, F.when(F.col("off").isNull(), F.col(vec)).otherwise(F.col("_moved"))).drop("_moved", "off")


def sweep(docs: DataFrame, offs: DataFrame, alphas: list[float], vec: str = "vec") -> DataFrame:
    """One copy of docs for each alpha (part names it), shifted."""
    d = docs.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return apply(d, offs, F.col("alpha"), vec).withColumn("part", F.col("alpha").cast("string"))
