"""Sharding by sampled splitters [DataFrame functions only].

Records are ordered by (hash of the text, hash of the id), so equal texts lie side by side and a group
of copies of any size can still be divided.  A size-weighted sample of keys gives quantile boundaries
of fine ranges; a range that comes out overfull is sampled again and subdivided.  Exact sizes and
counts of the ranges (a small table) then place every record by its running total of bytes, so the
``bytes`` law holds to within one record, and the slots of a shard are gapless without one task ever
holding a shard.

Only ids, sizes and hashes are moved; texts stay where they are until ``write_shards``.  Null texts
have size 8 and the crc32 of the empty text; null ids sort by their hash like others; repeated rows
get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize

#: Bytes that a record has besides its text.
OVERHEAD = 8
#: Fine ranges for each shard, keys sampled for each range, rounds of subdivision.
RANGES_PER_SHARD = 8
SAMPLE_PER_RANGE = 48
ROUNDS = 3


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col)).alias("k2"),
        *more,
    )


def _longs(values: list[int]) -> Column:
    """A constant array, as one expression."""
    return F.from_json(F.lit(str(values)), "array<bigint>") if values else F.array().cast("array<bigint>")


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the key: a binary search in two constant arrays."""
    if not splitters:
        return F.lit(0)
    a, b = _longs([x for x, _ in splitters]), _longs([y for _, y in splitters])
    steps = F.array(*[F.lit(1 << i) for i in range(len(splitters).bit_length() - 1, -1, -1)])

    def step(lo, width):
        at = lo + width - 1
        x, y = F.get(a, at), F.get(b, at)
        below = (x < F.col("k1")) | ((x == F.col("k1")) & (y <= F.col("k2")))
        return F.when((lo + width <= len(splitters)) & below, lo + width).otherwise(lo)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(sample: list, n: int) -> list[tuple[int, int]]:
    """n - 1 boundaries of equal weight in a bounded sample of (k1, k2, weight)."""
    sample = sorted((r.k1, r.k2, r.w) for r in sample)
    total, out, run, i = sum(r[2] for r in sample), [], 0.0, 1
    for k1, k2, w in sample:
        run += w
        while i < n and run >= total * i / n:
            out.append((k1, k2))
            i += 1
    return sorted(set(out))


def _sample(meta: DataFrame, total: float, target: int, seed: int) -> list:
    """About target keys, each drawn with a chance proportional to its size (large ones count more)."""
    chance = F.col("size") * F.lit(target / max(total, 1.0))
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return meta.where(u < chance).select("k1", "k2", F.greatest(chance, F.lit(1.0)).alias("w")).collect()


def splitters(meta: DataFrame, n_ranges: int) -> tuple[list[tuple[int, int]], list]:
    """Boundaries, and each range's size and count: (range, bytes, rows) in order."""
    total = meta.agg(F.sum("size")).first()[0] or 0
    found = _quantiles(_sample(meta, total, n_ranges * SAMPLE_PER_RANGE, 1), n_ranges)
    for i in range(ROUNDS + 1):
        each = sorted(meta.groupBy(range_of(found).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        over = [r for r in each if r["rows"] > 1 and r["bytes"] > 2 * total / n_ranges]
        if i == ROUNDS or not over:
            return found, each
        inside = meta.withColumn("range", range_of(found)).where(F.col("range").isin([r["range"] for r in over]))
        size = sum(r["bytes"] for r in over)
        parts = -(-size * n_ranges // max(total, 1)) * 2
        more = _quantiles(_sample(inside, size, int(parts) * SAMPLE_PER_RANGE, 2 + i), int(parts))
        if not set(more) - set(found):
            return found, each
        found = sorted({*found, *more})
    raise AssertionError


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(_longs(values), at)


def _placed(rows: DataFrame, found: list[tuple[int, int]], each: list, n_shards: int) -> DataFrame:
    """Adds shard and place (the position among all rows); rows: k1, k2, size, text_crc32 and others."""
    n = len(found) + 1
    size, count = [0] * n, [0] * n
    for r in each:
        size[r["range"]], count[r["range"]] = r["bytes"], r["rows"]
    total = sum(size)
    bytes_before = [sum(size[:i]) for i in range(n)]
    rows_before = [sum(count[:i]) for i in range(n)]
    w = Window.partitionBy("range").orderBy("k1", "k2", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("range", range_of(found))
    middle = _lookup(bytes_before, F.col("range")) + F.sum("size").over(w) - F.col("size") / 2
    return rows.withColumns({
        "shard": F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(total, 1))).cast("int"),
        "place": (_lookup(rows_before, F.col("range")) + F.row_number().over(w) - 1).cast("long"),
    })


def assign(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; the law is ``bytes``."""
    meta = materialize(keyed(docs, id_col, text_col), "shard-keys")
    found, each = splitters(meta, n_shards * RANGES_PER_SHARD)
    placed = materialize(_placed(meta, found, each, n_shards).select("doc_id", "size", "text_crc32", "shard", "place"), "shard-places")
    discard(meta)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = _lookup([first.get(i, 0) for i in range(n_shards)], F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write whole records into one folder for each shard, by the law of ``assign``; returns the folders' column.

    The column is ``shard``, with underscores behind it if docs has such a column; docs' own columns are all
    kept.  Every range is a task, so a shard is several tasks and files.
    """
    meta = materialize(keyed(docs, id_col, text_col), "shard-keys")
    found, each = splitters(meta, n_shards * RANGES_PER_SHARD)
    discard(meta)
    rows = keyed(docs, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    name = free_name("shard", docs.columns)
    _placed(rows, found, each, n_shards).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
