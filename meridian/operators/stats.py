"""Rank statistics over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, name: str, by: str, tie: str, method: str = "ordinal") -> DataFrame:
    """Adds a rank column; ordinal breaks ties by the tie column, average shares them.

    A rank is a global order: Spark sorts the rows by range, and the position is a row's place in its
    range plus the sizes of the ranges before, so no single task ranks everything.
    """
    keys = [F.col(by), F.col(tie)]
    parts = df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    parts = parts.persist()
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row a partition
    out = parts.join(F.broadcast(before), "_p").withColumn(name, (F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) + F.col("_b")).cast("double"))
    if method == "average":
        mean = out.groupBy(by).agg(F.avg(name).alias("_m"))
        out = out.drop(name).join(mean, by).withColumnRenamed("_m", name)
    return out.drop("_p", "_b")


def ranked(df: DataFrame, columns: list[str], tie: str, method: str = "ordinal") -> DataFrame:
    """Adds r_<column> for each column."""
    for c in columns:
        df = with_rank(df, f"r_{c}", c, tie, method)
    return df


def partial(ab: Column, ac: Column, bc: Column) -> Column:
    """Correlation of a and b without what c explains."""
    return (ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc))
