"""Structured Streaming forms of the scan operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import MIN_CONFIDENCE
from ..storage import new_path


def best_readings(blocks: DataFrame) -> DataFrame:
    """The best reading of each scan and text so far; an update-mode aggregation, state is one row a key."""
    b = blocks.where(F.col("confidence") >= MIN_CONFIDENCE).withColumn("key", F.lower(F.trim("text")))
    score = F.round(F.col("confidence") * F.col("area"), 9)
    best = F.max_by(F.struct("frame", "pos", "text", "confidence", "area"), F.struct(score, -F.col("frame"), -F.col("pos")))
    return b.groupBy("scan_id", "key").agg(best.alias("b"), F.count("*").alias("seen")).select("scan_id", "key", "b.*", "seen")


def scan_memory(scans: DataFrame) -> DataFrame:
    """brand, registry, times: how often each product was scanned."""
    return scans.groupBy("brand", "registry").agg(F.count("*").alias("times"))


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, closed by a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is and return its result table.

    State and progress lie in the shared folder, so the run survives lost executors.  In "complete" mode the
    last result replaces the ones before, whatever the batches were; it is written as Parquet, never held by the driver.
    """
    spark, out = stream.sparkSession, {"path": ""}

    def keep(batch: DataFrame, _: int) -> None:
        out["path"] = new_path(spark, name)
        batch.write.parquet(out["path"])

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-state")).foreachBatch(keep).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out["path"]) if out["path"] else spark.createDataFrame([], stream.schema)
