"""Token counts of a unigram tokenizer: Aho-Corasick matches and a count-only Viterbi.

The tokenizer: every space becomes U+2581, one is put before a text that does not begin with it, and
each U+2581 begins a word; a word's pieces are the best-scoring path over the vocabulary.  Tie rules:
a path to a place is replaced only by a strictly better score, longer last pieces are tried first, a
character without a piece of its own costs the lowest score less 10, and neighbouring unknown
characters count as one piece.  Only score and piece count are carried, never the path.

Words are counted once for all documents (a global distinct-word shuffle).  Null and empty texts have
no tokens; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks
from .common import id_and_text, pack

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = pc.split_pattern(pc.replace_substring(text, SPACE_MARK, " "), " ")
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    keep = np.ones(len(flat), dtype=bool)
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)[first]
    before = np.concatenate([[0], np.cumsum(keep)])
    d = pc.dictionary_encode(flat.filter(pa.array(keep)))
    return d.dictionary, np.asarray(d.indices, dtype=np.int64), before[offsets[1:]] - before[offsets[:-1]]


def counter(vocabulary: list[tuple[str, float]]) -> Callable[[str], int]:
    """The piece count of a word (without its mark)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for piece, score in vocabulary:
        a.add_word(piece, (len(piece), score))
    a.make_automaton()
    unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(word: str) -> int:
        word = SPACE_MARK + word
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        pieces, last_unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0

        def unmatched(end: int) -> None:
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end], pieces[end], last_unknown[end] = score, pieces[end - 1] + (not last_unknown[end - 1]), True

        single = False
        for end, (size, score) in a.iter(word):
            end += 1
            while done < end - 1:  # ends without more matches
                done += 1
                if not single:
                    unmatched(done)
                single = False
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], pieces[end], last_unknown[end] = score, pieces[end - size] + 1, False
            single |= size == 1
        while done < n:
            done += 1
            if not single:
                unmatched(done)
            single = False
        return pieces[n]

    return count


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words for every document."""
    docs = id_and_text(docs, id_col, text_col)
    buckets = blocks.bucket_count(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = counter(shared.value), {}
        for b in batches:
            vals = []
            for n, raw in zip(b.column("lens").to_pylist(), b.column("words").to_pylist(), strict=True):
                if len(memo) > MEMO:
                    memo.clear()
                got = []
                for w in blocks.unpack_words(n, raw):
                    k = memo.get(w)
                    if k is None:
                        k = memo[w] = count(w.decode())
                    got.append(k)
                vals.append(pack(np.array(got, dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("start"), b.column("n"), pa.array([pack(np.zeros(0, np.uint8))] * len(vals), pa.binary()), pa.array(vals, pa.binary())], names=["block", "start", "n", "lens", "vals"])

    def finish(lens: bytes, vals: bytes, counts: np.ndarray, codes: np.ndarray, columns: dict) -> pa.Table:
        each = np.frombuffer(vals, np.uint32).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each[codes])])
        ends = np.cumsum(counts)
        return pa.table({"doc_id": columns["doc_id"], "n_tokens": pa.array(total[ends] - total[ends - counts], pa.int64()), "n_words": pa.array(counts, pa.int64())})

    words = blocks.dictionaries(docs, split_words, buckets).repartition(buckets, "bucket")
    values = words.mapInArrow(count_words, blocks.VALUES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.reassemble(values, docs, split_words, buckets, finish, f"doc_id {kind}, n_tokens long, n_words long")
