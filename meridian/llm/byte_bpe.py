"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

A text is cut where a single space stands between two characters that are no white space.  No match
of the pre-token pattern crosses such a place (a space before a non-space always begins a new match),
so encoding the pieces equals encoding the text, and each distinct piece is split by the pattern and
encoded once for all documents.

Null and empty texts give no ids; a text without spaces is one piece; repeated rows give repeated
results; an empty table gives an empty table.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import blocks
from .common import id_and_text, pack, ranges, release, slices

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Texts with other white space around a space, or a space at an end, take the slower way.
_IRREGULAR = f"{_SPACE} | {_SPACE}|^ | $|^$"
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Words remembered by an encoding task; beyond that it starts afresh (the results don't change).
MEMO = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of all texts; every piece but a text's first keeps its space."""
    odd = np.asarray(pc.match_substring_regex(text, _IRREGULAR), dtype=bool)
    counts = np.zeros(len(text), dtype=np.int64)
    lists = pc.split_pattern(text.filter(pa.array(~odd)), " ")
    plain = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    counts[~odd] = np.diff(offsets)
    slow = [_CUT.split(t) if t else [] for t in text.filter(pa.array(odd)).to_pylist()]
    counts[odd] = [len(p) for p in slow]
    flat = pa.concat_arrays([plain, pa.array([p for x in slow for p in x], plain.type)])
    d = pc.dictionary_encode(flat)
    codes = np.asarray(d.indices, dtype=np.int64) * 2
    # where each text's pieces lie: texts of the fast way first
    at = np.empty(len(text), dtype=np.int64)
    fast, late = np.flatnonzero(~odd), np.flatnonzero(odd)
    order = np.concatenate([fast, late])
    ends = np.cumsum(counts[order])
    at[order] = ends - counts[order]
    codes[at[counts > 0]] += 1
    used = np.zeros(2 * len(d.dictionary), dtype=bool)
    used[codes] = True
    place = np.cumsum(used) - 1
    which = np.flatnonzero(used)
    base = d.dictionary.take(pa.array(which >> 1))
    words = pc.binary_join_element_wise(pa.array(np.where(which & 1, "", " ")).cast(base.type), base, pa.scalar("", base.type))
    codes = place[codes][ranges(at, counts)]
    return words, codes, counts


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit token ids as binary, n_tokens."""
    docs = id_and_text(docs, id_col, text_col)
    buckets = blocks.bucket_count(docs)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # the vocabulary's size is fixed

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = shared.value
        to_ids = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        memo: dict[bytes, bytes] = {}
        for b in batches:
            lens, vals = [], []
            for n, raw in zip(b.column("lens").to_pylist(), b.column("words").to_pylist(), strict=True):
                if len(memo) > MEMO:
                    memo.clear()
                got = []
                for w in blocks.unpack_words(n, raw):
                    ids = memo.get(w)
                    if ids is None:
                        ids = memo[w] = np.array(to_ids(w.decode()), dtype="<u4").tobytes()
                    got.append(ids)
                lens.append(pack(np.fromiter(map(len, got), np.uint32, len(got)) >> 2))
                vals.append(pack(np.frombuffer(b"".join(got), np.uint8)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("start"), b.column("n"), pa.array(lens, pa.binary()), pa.array(vals, pa.binary())], names=["block", "start", "n", "lens", "vals"])
            release()

    def finish(lens: bytes, vals: bytes, counts: np.ndarray, codes: np.ndarray, columns: dict) -> pa.Table:
        size = np.frombuffer(lens, np.uint32).astype(np.int64)
        ids = np.frombuffer(vals, "<u4")
        start = np.cumsum(size) - size
        parts, n = [], []
        ends = np.cumsum(counts)
        for e, k in zip(ends.tolist(), counts.tolist(), strict=True):
            c = codes[e - k : e]
            got = ids[ranges(start[c], size[c])]
            parts.append(got.tobytes())
            n.append(len(got))
        return pa.table({"doc_id": columns["doc_id"], "ids": pa.array(parts, pa.binary()), "n_tokens": pa.array(n, pa.int64())})

    words = blocks.dictionaries(docs, split_pieces, buckets).repartition(buckets, "bucket")
    values = words.mapInArrow(encode_words, blocks.VALUES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.reassemble(values, docs, split_pieces, buckets, finish, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids, n_tokens and text_bytes: the ids joined with the token-byte table, in order."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        start, table = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        for b in slices(batches, "ids", 1 << 20):
            out = []
            for ids in b.column("ids").to_pylist():
                i = np.frombuffer(ids or b"", "<u4")
                out.append(table[ranges(start[i], size[i])].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "text_bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, text_bytes binary")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
