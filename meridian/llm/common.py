"""Shared pieces: shared-folder tables, Arrow text helpers, packing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

#: Code points that separate words in every contract of this subpackage.
SPACE = " \t\n\x0b\f\r"
BATCH_BYTES = 16 << 20
#: Bytes of text that a kernel works on at a time: its temporary arrays take some ten times as much.
SLICE_BYTES = 2 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it (columns differ by more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's planner takes the rows' size for (files' sizes; no job); 0 where it can't tell."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else 0


def bounded_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of at most BATCH_BYTES, which bounds both sides of a Python task.

    Spark knows this bound only as a setting of the session; it is lowered where it is higher, never raised.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs; a null text counts as empty."""
    return bounded_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def release() -> None:
    """Give freed memory back to the system: several workers share an executor and outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def keep_pages() -> None:
    """Keep freed memory of a few MB for the next array until release(): numpy's temporaries else go back to the system one by one, and each page's first touch costs."""
    if opt := getattr(ctypes.CDLL(None), "mallopt", None):  # glibc only
        opt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        opt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds at most max_bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order (ASCII white space separates), and the count of each text."""
    lists = pc.ascii_split_whitespace(text)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(keep)])
    counts = before[offsets[1:]] - before[offsets[:-1]]
    return (flat if keep.all() else flat.filter(pa.array(keep))), counts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of strings, and the dictionary."""
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    d = pc.dictionary_encode(flat)
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def hashed(words: pa.Array, seed: int = 0) -> np.ndarray:
    """Stable 64-bit hashes of strings (the same on every machine)."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def binaries(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, one after another, and where each begins (and the last ends)."""
    kind = np.int64 if pa.types.is_large_binary(words.type) or pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1] or bytes(8), dtype=kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def dealt(words: pa.Array) -> np.ndarray:
    """Stable 64-bit numbers of strings (the same on every machine) to deal them out by; plainer than hashed, all strings at once."""
    raw, offsets = binaries(words)
    lens = np.diff(offsets)
    powers = np.cumprod(np.full(int(lens.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    sums = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(offsets[:-1], lens)], dtype=np.uint64))
    return mix(sums[offsets[1:]] - sums[offsets[:-1]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated index ranges starts[i] .. starts[i] + lens[i]."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lens), lens)


def train_rows(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; 0 marks held-out rows.  A null id is a training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(1))
