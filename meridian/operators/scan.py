"""Text blocks of several frames: best readings, a query text, the product they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MIN_CONFIDENCE = 0.30
TEMPERATURE, CANDIDATES, CONFIDENT = 0.02, 5, 0.55


def post_process(raw: DataFrame) -> DataFrame:
    """Raw boxes (x, y, w, h from below) to blocks: confidence floor, area, box from above."""
    return raw.where(F.col("confidence") >= MIN_CONFIDENCE).withColumns({"area": F.round(F.col("w") * F.col("h"), 5), "box": F.array(*[F.round(x, 4) for x in (F.col("x"), 1 - F.col("y") - F.col("h"), F.col("w"), F.col("h"))])})


def best_readings(blocks: DataFrame) -> DataFrame:
    """One block for each scan and lower-case text: the highest confidence times area, the earliest on ties."""
    key = F.lower(F.trim("text"))
    b = blocks.where(F.col("confidence") >= MIN_CONFIDENCE).withColumn("key", key)
    score = F.round(F.col("confidence") * F.col("area"), 9)
    best = F.max_by(F.struct("frame", "pos", "text", "confidence", "area"), F.struct(score, -F.col("frame"), -F.col("pos")))
    return b.groupBy("scan_id", "key").agg(best.alias("b"), F.count("*").alias("seen")).select("scan_id", "key", "b.*", "seen")


def query_text(blocks: DataFrame, top: int = 6) -> DataFrame:
    """scan_id, query: the largest blocks' texts, short ones and repeats dropped."""
    w = Window.partitionBy("scan_id").orderBy(F.col("area").desc(), "frame", "pos")
    t = blocks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).withColumn("t", F.trim("text")).where(F.length("t") >= 2)
    first = t.groupBy("scan_id", F.lower("t").alias("k")).agg(F.min_by("t", "r").alias("t"), F.min("r").alias("r"))
    return first.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda z: z["t"]), ", ").alias("query"))


def with_probability(hits: DataFrame) -> DataFrame:
    """Adds p: the softmax share among the first candidates of each query."""
    w = Window.partitionBy("query_id")
    h = hits.where(F.col("rank") <= CANDIDATES)
    h = h.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / TEMPERATURE))
    return h.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def identify(blocks: DataFrame, hits: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, doc_id, brand, short, p, confident, text, located_by, runner_up.

    hits: query_id, doc_id, score, rank in the query's own language; names: doc_id, brand.
    """
    h = with_probability(hits).join(names, "doc_id")
    best = h.where("rank = 1").drop("rank")
    second = h.where("rank = 2").select("query_id", F.col("brand").alias("brand2"))
    best = best.withColumn("want", F.when(F.size(T.brand_head("brand")) > 0, T.brand_head("brand")).otherwise(T.word_set("brand")))
    b = blocks.withColumnRenamed("scan_id", "query_id").join(best.select("query_id", "want"), "query_id")
    b = b.withColumn("overlap", F.size(F.array_intersect("want", T.word_set("text"))))
    block = b.groupBy("query_id").agg(F.max_by(F.struct("text", "overlap"), F.struct("overlap", "area", -F.col("frame"), -F.col("pos"))).alias("b"))
    out = best.join(second, "query_id", "left").join(block, "query_id")
    short, other = T.brand_short("brand"), T.brand_short("brand2")
    return out.select(
        "query_id", "doc_id", "brand", short.alias("short"), "p", (F.col("p") >= CONFIDENT).alias("confident"), F.col("b.text").alias("text"),
        F.when(F.col("b.overlap") > 0, "name").otherwise("largest type").alias("located_by"), F.when(F.col("brand2").isNotNull(), F.when(F.lower(short) == F.lower(other), F.col("brand2")).otherwise(other)).alias("runner_up"),
    )
