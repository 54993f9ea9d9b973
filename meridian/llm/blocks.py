"""Global distinct-word shuffle over blocks of documents.

Documents are cut into blocks of bounded text bytes.  A block's distinct words leave it once, dealt
over ``buckets`` by a hash of the word; a bucket works on each distinct word once; the values go back
to the block, which holds its documents as positions into its own dictionary.  What is shuffled grows
with the blocks' distinct words, never with all word positions, and no word has more rows than there
are blocks, so a word that fills a third of the corpus is no hot key.

The documents are read twice with the same splitter (dictionaries first, positions second); that
costs CPU time and saves writing the positions out (``once`` writes them out and reads once).  A block is named by a hash of its contents, so
both readings agree whatever task they run in; a block without its dictionary is an error, never a
silent loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import estimated_bytes, hashed, materialize, pack, release, shuffle_partitions, slices, unpack

#: Bytes of text in a block: bounds the memory of a task.
BLOCK_BYTES = 8 << 20
#: Bytes of input for each bucket of words: bounds a bucket's words.
BUCKET_BYTES = 64 << 20

#: words (dictionary), code of each position, number of positions of each document
Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]
#: numbers that words are dealt over buckets by
Number = Callable[[pa.Array], np.ndarray]


def _key(batch: pa.RecordBatch, part: int) -> int:
    """The block's name; its lowest bit is the part of the table that it is of."""
    h = xxhash.xxh3_64()
    text = pc.fill_null(batch.column("text"), "")
    lens = np.asarray(pc.binary_length(text), dtype=np.int32)
    h.update(lens.tobytes())
    h.update(repr(batch.column("doc_id").to_pylist()).encode())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
    if len(text) and offsets[-1] > offsets[0]:
        h.update(memoryview(text.buffers()[2])[offsets[0] : offsets[-1]])
    return (h.intdigest() & ~1 | part) - (1 << 63)


def _dictionary(batch: pa.RecordBatch, split: Split, buckets: int, number: Number = hashed):
    """The block's words in bucket order, the bucket borders, and positions in that order."""
    words, codes, counts = split(pc.fill_null(batch.column("text"), ""))
    bucket = (number(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    borders = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return words.take(pa.array(order)), borders, place[codes] if len(codes) else codes, counts


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    lens = np.asarray(pc.binary_length(words), dtype=np.uint32)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return pack(lens), pack(raw)


def unpack_words(lens: bytes, raw: bytes) -> list[bytes]:
    n, data = unpack(lens, np.uint32), unpack(raw, np.uint8).tobytes()
    ends = np.cumsum(n, dtype=np.int64)
    return [data[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


def joined_words(lens: list[bytes], raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of packed dictionaries as one array, and how many each dictionary has."""
    lens = [unpack(x, np.uint32) for x in lens]
    offsets = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.uint32), *lens]), dtype=np.int64))
    raw = b"".join(unpack(x, np.uint8).tobytes() for x in raws)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.array([len(x) for x in lens], dtype=np.int64)


DICT = "bucket int, block long, start int, n int, lens binary, words binary, counts binary"
VALUES = "block long, start int, n int, lens binary, vals binary"


def _dictionary_rows(b: pa.RecordBatch, words: pa.Array, borders: np.ndarray, codes: np.ndarray, counts: np.ndarray, counted: str | None, key: int) -> pa.RecordBatch:
    each = None
    if counted:
        use = np.repeat(np.asarray(b.column(counted).fill_null(False), dtype=bool), counts)
        each = np.bincount(codes[use], minlength=len(words)).astype(np.uint32)
    out = {k: [] for k in ("bucket", "start", "n", "lens", "words", "counts")}
    for i in np.flatnonzero(np.diff(borders)):
        lo, hi = int(borders[i]), int(borders[i + 1])
        lens, raw = pack_words(words.slice(lo, hi - lo))
        for k, v in zip(out, (int(i), lo, hi - lo, lens, raw, pack(each[lo:hi]) if counted else None), strict=True):
            out[k].append(v)
    n = len(out["n"])
    return pa.RecordBatch.from_arrays(
        [pa.array(out["bucket"], pa.int32()), pa.array([key] * n, pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["lens"], pa.binary()), pa.array(out["words"], pa.binary()), pa.array(out["counts"], pa.binary())],
        names=["bucket", "block", "start", "n", "lens", "words", "counts"],
    )


def dictionaries(docs: DataFrame, split: Split, buckets: int, counted: str | None = None, part: int = 0) -> DataFrame:
    """Rows of DICT.  counted: a boolean column; counts then holds each word's positions in its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK_BYTES):
            words, borders, codes, counts = _dictionary(b, split, buckets)
            yield _dictionary_rows(b, words, borders, codes, counts, counted, _key(b, part))

    return docs.mapInArrow(run, DICT)


def _positions_row(b: pa.RecordBatch, words: pa.Array, codes: np.ndarray, counts: np.ndarray, kept: list[str], key: int) -> pa.RecordBatch:
    cols = [pa.array([key], pa.int64())]
    for name in kept:
        c = b.column(name)
        cols.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
    cols += [pa.array([pack(counts.astype(np.uint32))], pa.binary()), pa.array([pack(codes.astype(np.uint32))], pa.binary()), pa.array([len(words)], pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["block", *kept, "counts", "codes", "n_words"])


def positions(docs: DataFrame, split: Split, buckets: int, part: int = 0, counted: str | None = None, number: Number = hashed) -> DataFrame:
    """A row for each block: its documents, their numbers of positions, and the positions' words.

    With counted, the rows of dictionaries come along (see once); columns of docs must not be named like those of DICT then.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    schema = T.StructType([*(T._parse_datatype_string(DICT).fields if counted else [T.StructField("block", T.LongType()), T.StructField("counts", T.BinaryType())]), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept], T.StructField("codes", T.BinaryType()), T.StructField("n_words", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK_BYTES):
            words, borders, codes, counts = _dictionary(b, split, buckets, number)
            key = _key(b, part)
            for rows in ([_dictionary_rows(b, words, borders, codes, counts, counted, key)] if counted else []) + [_positions_row(b, words, codes, counts, names, key)]:
                yield pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in rows.schema.names else pa.nulls(rows.num_rows, f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, schema)


def once(docs: DataFrame, split: Split, buckets: int, counted: str, number: Number = hashed) -> tuple[DataFrame, DataFrame]:
    """The rows of dictionaries and those of positions from one reading, by a table in the shared folder that holds both.

    That spares splitting the documents again and costs the disk of the positions.
    """
    both = materialize(positions(docs, split, buckets, 0, counted, number), "blocks")
    words = [f.name for f in T._parse_datatype_string(DICT).fields]
    return both.where("bucket is not null").select(words), both.where("bucket is null").select("block", "counts", *(c for c in both.columns if c not in words))


def reassemble(values: DataFrame, docs: DataFrame | dict[int, DataFrame], split: Split, buckets: int, finish, schema, rows: DataFrame | None = None) -> DataFrame:
    """Bring each block's word values to its documents; docs: a table, or its parts by number; rows: its positions, if at hand.

    finish(lens, vals, counts, codes, columns): lens and vals are the block's word values in word
    order, columns holds the documents' other columns; it returns a pyarrow Table of schema.
    """
    parts = docs if isinstance(docs, dict) else {0: docs}
    docs = next(iter(parts.values()))
    names = [f.name for f in docs.schema.fields if f.name != "text"]
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(left.column("start").to_pylist(), range(left.num_rows), strict=True))
        order = [got[k] for k in sorted(got)]
        n = sum(left.column("n")[i].as_py() for i in order)
        lens = b"".join(unpack(left.column("lens")[i].as_py(), np.uint8).tobytes() for i in order)
        vals = b"".join(unpack(left.column("vals")[i].as_py(), np.uint8).tobytes() for i in order)
        out = []
        for i in range(right.num_rows):
            if right.column("n_words")[i].as_py() != n:
                raise RuntimeError("a block and its dictionary differ: the input changed between two readings")
            columns = {k: right.column(k).chunk(0)[i].values if right.column(k).num_chunks == 1 else right.column(k)[i].values for k in names}
            out.append(finish(lens, vals, unpack(right.column("counts")[i].as_py(), np.uint32).astype(np.int64), unpack(right.column("codes")[i].as_py(), np.uint32).astype(np.int64), columns))
        release()
        return pa.concat_tables(out).cast(arrow) if out else arrow.empty_table()

    for part, d in parts.items() if rows is None else ():
        more = positions(d, split, buckets, part)
        rows = more if rows is None else rows.union(more)
    return values.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(join, schema)


def bucket_count(docs: DataFrame) -> int:
    """Buckets by the input's size, so that one bucket's words fit in a task whatever the input."""
    return max(shuffle_partitions(docs.sparkSession), -(-estimated_bytes(docs) // BUCKET_BYTES))
