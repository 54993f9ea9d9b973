"""The answers of a service as DataFrames: thin selections from the registered plans, one function an endpoint.

Every function takes (spark, sf_dir) and the request's parameters; serving them as JSON is the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import knn
from ..sources import fixtures as X
from . import evaluation, geometry, lexical, retrieval


def search(spark, d, query_id: int, k: int = 10, lang: str | None = None) -> DataFrame:
    """The nearest rows of a row, in one language if given."""
    c = X.vectors(spark, d)
    docs = c if lang is None else c.where(F.col("lang") == lang)
    return knn(c.where(F.col("id") == query_id), docs, k).join(c.select(F.col("id").alias("doc_id"), "concept", "lang"), "doc_id").select("doc_id", "rank", "score", "concept", "lang")


def compare(spark, d, query_id: int) -> DataFrame:
    """Both answers of a row, without and with the shift, summed up."""
    return retrieval.off_on_compare(spark, d).where(F.col("query_id") == query_id)


def methods(spark, d, query_id: int) -> DataFrame:
    """The best of every retrieval method side by side."""
    return lexical.method_compare_corpus(spark, d).where(F.col("query_id") == query_id)


def panels(spark, d, query_id: int, k: int = 10) -> DataFrame:
    """Hyperbolic, flat and text neighbours of a row."""
    return geometry.three_panels(spark, d).where((F.col("query_id") == query_id) & (F.col("rank") <= k))


def ancestors(spark, d, category_id: int) -> DataFrame:
    """A category's path, depth and ancestors, root first."""
    return evaluation.panel_ancestors(spark, d).where(F.col("id") == category_id)


def disk(spark, d, code: str) -> dict[str, DataFrame]:
    """The disk: points, the code's chain from the root, the drawn path through it, and its siblings' profiles."""
    own = F.col("code") == code
    return {"points": geometry.disk_view(spark, d), "chain": evaluation.disk_chain(spark, d).where(own), "path": evaluation.disk_path(spark, d).where(own), "siblings": evaluation.sibling_profile(spark, d).where(own)}


def anomalies(spark, d) -> DataFrame:
    """Depth against radius: a seeded sample and the rows furthest from their level."""
    return evaluation.depth_scatter(spark, d)


def tree(spark, d) -> DataFrame:
    """Nodes with children, coordinates and radius."""
    return geometry.tree_geometry(spark, d)


def demo_queries(spark, d, k: int = 200) -> DataFrame:
    """The queries that the shift helps most."""
    return evaluation.demo_ranking(spark, d).where(F.col("place") <= k)


def language(spark, d) -> DataFrame:
    """The language that every text is searched in."""
    return evaluation.language_used(spark, d)


def identify(spark, d) -> DataFrame:
    """Which product each scan shows."""
    return lexical.identify_product(spark, d)
