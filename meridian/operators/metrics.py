"""Retrieval metrics over ranked hits (part, query_id, doc_id, rank, score)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r4(x: Column) -> Column:
    return F.round(x, 4) + F.lit(0.0)


def judged(hits: DataFrame, info: DataFrame) -> DataFrame:
    """Hits with q_concept, q_lang, concept and lang; info: id, concept, lang."""
    q = info.select(F.col("id").alias("query_id"), F.col("concept").alias("q_concept"), F.col("lang").alias("q_lang"))
    d = info.select(F.col("id").alias("doc_id"), "concept", "lang")
    return hits.join(q, "query_id").join(d, "doc_id").withColumn("match", F.col("concept") == F.col("q_concept"))


def recall_and_hits(j: DataFrame, target: str, k: int = 10) -> DataFrame:
    """part, lang, n, recall, tgt_hits by the query's language."""
    top = j.where(F.col("rank") <= k)
    per = top.groupBy("part", "q_lang", "query_id").agg(F.max(F.col("match").cast("double")).alias("hit"), F.sum((F.col("match") & (F.col("lang") == target)).cast("double")).alias("tgt"))
    return per.groupBy("part", F.col("q_lang").alias("lang")).agg(F.count("*").alias("n"), r4(F.avg("hit")).alias("recall"), r4(F.avg("tgt")).alias("tgt_hits"))


def ndcg_and_target(j: DataFrame, info: DataFrame, target: str, k: int = 20) -> DataFrame:
    """part, lang, n, ndcg, tlr, tlr_ceiling; a concept without another document has gain 0 and still counts."""
    per = j.where(F.col("rank") <= k).groupBy("part", "q_lang", "query_id", "q_concept").agg(
        F.sum(F.when(F.col("match"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum((F.col("match") & (F.col("lang") == target)).cast("double")).alias("tgt"),
    )
    size = info.groupBy(F.col("concept").alias("q_concept")).agg(F.count("*").alias("r"), F.sum((F.col("lang") == target).cast("long")).alias("rt"))
    per = per.join(F.broadcast(size), "q_concept")  # a row a concept
    ideal = [0.0]
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + 1 / math.log2(i + 1))
    kk = F.least(F.lit(k), F.col("r") - 1).cast("int")
    rt = (F.col("rt") - (F.col("q_lang") == target).cast("long")).cast("double")
    per = per.withColumns({"nd": F.when(kk > 0, F.col("dcg") / F.get(F.array(*map(F.lit, ideal)), kk)).otherwise(0.0), "t": rt})
    some = F.col("t") > 0
    return per.groupBy("part", F.col("q_lang").alias("lang")).agg(
        F.count("*").alias("n"), r4(F.avg("nd")).alias("ndcg20"), r4(F.avg(F.when(some, F.col("tgt") / F.col("t")))).alias("tlr20"), r4(F.avg(F.when(some, F.least(F.col("t"), F.lit(float(k))) / F.col("t")))).alias("tlr20_ceiling")
    )


def hit_at(j: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """part, n, hit_k .., mrr3: of the first matching hit; queries (part, query_id) without a hit count as misses."""
    first = j.where("match").groupBy("part", "query_id").agg(F.min("rank").alias("r"))
    per = queries.join(first, ["part", "query_id"], "left")
    return per.groupBy("part").agg(
        F.count("*").alias("n"),
        *[r4(F.avg((F.coalesce(F.col("r"), F.lit(10**6)) <= k).cast("double"))).alias(f"hit_{k}") for k in ks],
        r4(F.avg(F.when(F.col("r") <= 3, 1.0 / F.col("r")).otherwise(0.0))).alias("mrr3"),
    )


def average_precision(order: DataFrame) -> DataFrame:
    """query_id, npos, ap from all other nodes in order (query_id, rank, hit)."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = order.withColumn("prec", F.when(F.col("hit"), F.sum(F.col("hit").cast("double")).over(w) / F.col("rank")))
    return d.groupBy("query_id").agg(F.sum(F.col("hit").cast("long")).alias("npos"), F.sum("prec").alias("s")).where("npos > 0").select("query_id", "npos", (F.col("s") / F.col("npos")).alias("ap"))
