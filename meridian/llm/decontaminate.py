"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased and without punctuation at their ends.  For every place of a test item
the shortest n-gram (2 to 8 words) that chance would bring at most once into the whole corpus is a
seed; how likely chance is follows from counts of the items' words over all documents, so a passage
that was copied a thousand times stays a seed.  Documents that hold a seed are aligned with its item
around it: match 1, mismatch and gap -1/2, divided by the item's length.  A score of at least MIN_SCORE
is a leak; copies with changed, dropped or added words keep most of their score.

A benchmark of at most ITEMS rows and ITEM_BYTES of text is broadcast: one reading of the documents counts,
one finds seeds and aligns.  A larger one is never held in one place: its seeds are a table, joined by hash
with the documents' runs of words that a bit set of bounded size (FILTER_BITS) lets through.  Both ways give
the same rows.  Null or empty texts on either side never match; items of one word are compared as whole
items; repeated rows are each reported; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, coded, discard, hashed, id_and_text, materialize, mix, pack, slices, unpack, words_of

#: A benchmark up to this size is broadcast.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: The bit set of a larger one: at most 2 ** 28 bits (32 MB); beyond some 20 million seeds more runs pass.
FILTER_BITS = 28
SHORTEST, LONGEST = 2, 8
#: Chance hits in the corpus that a seed may have.
EXPECTED = 1.0
MIN_SCORE = 0.5
PENALTY = 0.5
_EDGES = "[^\\p{L}\\p{N}]+"


def bare_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Dictionary of normal words, codes and counts; words of punctuation only are dropped."""
    flat, counts = words_of(text)
    codes, words = coded(flat)
    again, words = coded(pc.replace_substring_regex(pc.utf8_lower(words), f"^{_EDGES}|{_EDGES}$", ""))
    codes = again[codes] if len(codes) else codes
    keep = np.asarray(pc.greater(pc.binary_length(words), 0), dtype=bool)[codes] if len(codes) else np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(counts)), counts)
    return words, codes[keep], np.bincount(doc[keep], minlength=len(counts))


def seed_places(rate: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Place and length of an item's seeds; rate: logarithms of its words' shares of the corpus."""
    n = len(rate)
    for at in range(n):
        chance = np.log(max(total, 1)) + np.cumsum(rate[at : at + LONGEST])
        low = np.flatnonzero(chance[SHORTEST - 1 :] <= np.log(EXPECTED))
        size = SHORTEST + int(low[0]) if len(low) else LONGEST
        if at + size > n:
            if at:
                return  # covered by the seeds before
            size = n
        yield at, size


class Items:
    """Test items: vocabulary, words of each item, and its seeds."""

    def __init__(self, ids: list, texts: list[str]):
        words, codes, counts = bare_words(pa.array(texts, pa.string()))
        self.ids, ends = ids, np.cumsum(counts)
        self.words = words.to_pylist()
        self.vocabulary = {w: i + 1 for i, w in enumerate(self.words)}
        self.items = [codes[e - n : e] + 1 for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        self.lengths: list[int] = []

    def seed(self, counts: np.ndarray, total: int) -> None:
        """Choose the seeds; counts: of the vocabulary's words (place i: word i + 1) in the corpus."""
        rate = np.log(np.maximum(counts, 1.0) / max(total, 1))
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, item in enumerate(self.items):
            for at, size in seed_places(rate[item - 1], total):
                found.setdefault(size, {}).setdefault(int(hash_runs(item[at : at + size], size)[0]), []).append((k, at))
        self.seeds = {n: (np.array(sorted(t), dtype=np.uint64), [t[h] for h in sorted(t)]) for n, t in found.items()}

    def codes(self, words: pa.Array) -> np.ndarray:
        place = pc.index_in(words, value_set=pa.array(self.words, pa.string()))
        return np.asarray(pc.fill_null(pc.add(place, 1), 0), dtype=np.int64)


def hash_runs(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n codes."""
    m = len(codes) - n + 1
    h = np.zeros(max(m, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if m > 0 else 0):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m].astype(np.uint64))
    return h


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment: score by the item's length, and the text place after its last word."""
    gap = PENALTY * np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1), 0.0, 0
    for w in item.tolist():
        new = np.zeros(len(text) + 1)
        new[1:] = np.maximum(np.where(text == w, row[:-1] + 1, row[:-1] - PENALTY), 0)
        np.maximum(new, row - PENALTY, out=new)
        new = np.maximum.accumulate(new + gap) - gap  # gaps along the text
        at = int(new.argmax())
        if new[at] > best:
            best, end = float(new[at]), at
        row = new
    return best / max(len(item), 1), end


def _hits(items: Items, codes: np.ndarray, counts: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(document, item): (place in the document, place in the item) of every seed found."""
    ends = np.cumsum(counts)
    run = np.zeros(len(codes) + 1, dtype=np.int64)  # known words in a row from each place on
    known = codes > 0
    broken = np.flatnonzero(~known)
    border = np.searchsorted(broken, np.arange(len(codes)))
    stop = np.append(broken, len(codes))[border]
    stop = np.minimum(stop, np.repeat(ends, counts))
    run = stop - np.arange(len(codes))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, (seeds, where) in items.seeds.items():
        at = np.flatnonzero(run >= n)
        if not len(at):
            continue
        h = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64))
        place = np.searchsorted(seeds, h)
        place[place == len(seeds)] = 0
        hit = seeds[place] == h
        for a, p in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
            doc = int(np.searchsorted(ends, a, side="right"))
            start = int(ends[doc] - counts[doc])
            for item, offset in where[p]:
                out.setdefault((doc, item), []).append((a - start, offset))
    return out


def _windows(hits: list[tuple[int, int]], length: int, n: int) -> list[tuple[int, int]]:
    """Stretches of the document that an alignment through a hit can reach, merged."""
    slack = length // 2 + 4
    spans = sorted((max(0, at - offset - slack), min(n, at - offset + length + slack)) for at, offset in hits)
    out = [list(spans[0])]
    for a, b in spans[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _seeded(docs: DataFrame, items: Items):
    """Count the items' words over all documents, choose the seeds, broadcast."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, total = words.value, 0
        each = np.zeros(len(items.words) + 1, dtype=np.int64)
        for b in slices(batches, "text", SLICE_BYTES):
            dictionary, codes, _ = bare_words(b.column("text"))
            known = items.codes(dictionary)
            each += np.bincount(known[codes], minlength=len(each)) if len(codes) else 0
            total += len(codes)
        each[0] = total
        at = np.flatnonzero(each)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(each[at])], names=["word", "n"])

    counts = np.zeros(len(items.words) + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most the items' words
        counts[r.word] = r.n
    items.seed(counts[1:].astype(np.float64), int(counts[0]))
    return spark.sparkContext.broadcast(items)


def best_match(own: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], min_score: float) -> tuple[float, int, int] | None:
    """Score, first word and word after the last of an item's best alignment in a document, if it is a leak."""
    best = (0.0, 0, 0)
    for a, z in _windows(hits, len(words), len(own)):
        score, end = align(words, own[a:z])
        best = max(best, (score, -a, a + end))
    if best[0] < min_score:
        return None
    _, begin = align(words[::-1], own[: best[2]][::-1][: 3 * len(words)])
    return round(best[0], 6), best[2] - begin, best[2]


def _matches(items: Items, text: pa.Array, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, word after the last) of the leaks in a batch."""
    dictionary, codes, n = bare_words(text)
    known = items.codes(dictionary)[codes] if len(codes) else codes
    ends, out = np.cumsum(n), []
    for (doc, item), hits in sorted(_hits(items, known, n).items()):
        match = best_match(known[ends[doc] - n[doc] : ends[doc]], items.items[item], hits, min_score)
        if match:
            out.append((doc, item, *match))
    return out


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, bool]:
    """item_id, text of the benchmark, and whether that may be broadcast."""
    b = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    rows, size = b.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return b, rows <= ITEMS and size <= ITEM_BYTES


def _shared(docs: DataFrame, items: DataFrame):
    """Items with seeds, broadcast; docs: doc_id, text."""
    rows = sorted(items.collect(), key=lambda r: (str(r.item_id), r.text))  # at most ITEMS rows and ITEM_BYTES
    return _seeded(docs, Items([r.item_id for r in rows], [r.text for r in rows]))


def _hashed_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' normal words in order, and the count of each text."""
    words, codes, n = bare_words(text)
    return (hashed(words)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)), n


def _word_counts(docs: DataFrame) -> DataFrame:
    """word (a hash; null for all words together), n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            dictionary, codes, _ = bare_words(b.column("text"))
            n = np.bincount(codes, minlength=len(dictionary))
            word = pa.array(hashed(dictionary).view(np.int64).tolist() + [None], pa.int64())
            yield pa.RecordBatch.from_arrays([word, pa.array(n.tolist() + [len(codes)], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _item_words(items: DataFrame) -> DataFrame:
    """item, at, word of every word of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            words, n = _hashed_words(b.column("text"))
            at = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at, pa.int32()), pa.array(words.view(np.int64))], names=["item", "at", "word"])

    return items.select("item", "text").mapInArrow(run, "item long, at int, word long")


def _seed_table(words: DataFrame, total: int) -> DataFrame:
    """h, size, item, offset of every seed; words: item, at, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, own in zip(b.column("item").to_pylist(), b.column("own").to_pylist(), strict=True):
                codes = np.array([w["word"] for w in own], dtype=np.int64).view(np.uint64)
                rate = np.log(np.maximum([float(w["n"]) for w in own], 1.0) / max(total, 1))
                out += [(int(hash_runs(codes[at : at + size], size).view(np.int64)[0]), size, item, at) for at, size in seed_places(rate, total)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["h", "size", "item", "offset"])

    own = words.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "word", "n"))).alias("own"))
    return own.mapInArrow(run, "h long, size int, item long, offset int")


def _bits(seeds: DataFrame) -> np.ndarray:
    """The bit set of the seeds' hashes, 16 bits a seed within 2 ** 16 and 2 ** FILTER_BITS bits."""
    power = min(FILTER_BITS, max(16, (16 * seeds.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, part = np.zeros(1 << 16, dtype=bool), None
        for b in batches:
            part = b.column("part")[0]
            low[np.asarray(b.column("low"))] = True
        yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int64()), pa.array([np.packbits(low).tobytes()])], names=["part", "bits"])

    place = F.col("h").bitwiseAND(F.lit((1 << power) - 1))
    parts = seeds.select(F.shiftright(place, 16).alias("part"), place.bitwiseAND(F.lit(0xFFFF)).alias("low")).distinct()
    out = np.zeros((1 << power - 16, 1 << 13), dtype=np.uint8)
    for r in parts.groupBy("part").applyInArrow(run, "part long, bits binary").collect():  # at most 2 ** FILTER_BITS bits
        out[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def _marked(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, key, words (packed hashes), hits of the documents with a run of words that the bit set lets through."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, shared, last = docs.schema["doc_id"].dataType, docs.sparkSession.sparkContext.broadcast(bits), np.uint64(8 * len(bits) - 1)
    id_type, hit_type = to_arrow_type(kind), pa.struct([("h", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            words, n = _hashed_words(b.column("text"))
            ends = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            found = []
            for size in sizes:
                h = hash_runs(words, size)
                place = h & last
                hit = shared.value[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1
                at = np.flatnonzero(hit)
                at = at[at + size <= ends[doc[at]]]
                found.append((at, h[at]))
            at, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.argsort(doc[at], kind="stable")
            at, h = at[order], h[order]
            rows, starts = np.unique(doc[at], return_index=True)
            places = at - (ends - n)[doc[at]]
            hits = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(places, pa.int32())], fields=list(hit_type))
            packed = [pack(words[ends[r] - n[r] : ends[r]]) for r in rows.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), hits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())).cast(id_type), b.column("key").take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary()), lists], names=["doc_id", "key", "words", "hits"])

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, key string, words binary, hits array<struct<h: long, at: int>>")


def _joined(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame:
    """doc_id, key, item_id, score, start_word, end_word of every leak, written; docs: doc_id, text, key."""
    from pyspark.sql.pandas.types import to_arrow_type

    items = materialize(benchmark.withColumn("item", F.monotonically_increasing_id()), "items")
    counts = materialize(_word_counts(docs), "words")
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    words = materialize(_item_words(items), "item-words")
    counted = words.join(counts.where("word is not null"), "word", "left").fillna(0, ["n"])
    seeds = materialize(_seed_table(counted, total), "seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most LONGEST
    marked = materialize(_marked(docs, _bits(seeds), sizes).withColumn("doc", F.monotonically_increasing_id()), "marked")
    hits = marked.select("doc", F.explode("hits").alias("hit")).select("doc", "hit.*")
    pairs = hits.join(seeds, "h").groupBy("doc", "item").agg(F.collect_list(F.struct("at", "offset")).alias("places"))
    own = words.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]).alias("item_words"))
    both = pairs.join(own, "item").join(items.select("item", "item_id"), "item").join(marked.drop("hits"), "doc")
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    types = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", SLICE_BYTES):
            row, out = [], []
            for i in range(b.num_rows):
                text = unpack(b.column("words")[i].as_py(), np.uint64)
                item = np.asarray(b.column("item_words")[i].values, dtype=np.int64).view(np.uint64)
                match = best_match(text, item, [(p["at"], p["offset"]) for p in b.column("places")[i].as_py()], min_score)
                if match:
                    row.append(i)
                    out.append(match)
            score, start, stop = zip(*out, strict=True) if out else ((),) * 3
            kept = [b.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "key", "item_id")]
            yield pa.RecordBatch.from_arrays([kept[0].cast(types[0]), kept[1], kept[2].cast(types[1]), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "key", "item_id", "score", "start_word", "end_word"])

    schema = f"doc_id {kinds[0].simpleString()}, key string, item_id {kinds[1].simpleString()}, score double, start_word int, end_word int"
    out = materialize(bounded_batches(both).select("doc_id", "key", "item_id", "item_words", "words", "places").mapInArrow(run, schema), "leaks")
    discard(items, counts, words, seeds, marked)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score, start_word, end_word (places among the normal words) of every leak."""
    from pyspark.sql.pandas.types import to_arrow_type

    d = id_and_text(docs, id_col, text_col)
    items, small = _items(benchmark, item_col, item_text)
    if not small:
        return _joined(d.withColumn("key", F.lit("")), items, min_score).drop("key")
    kind, item_kind = d.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    item_type, shared = to_arrow_type(item_kind), _shared(d, items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            got = _matches(shared.value, b.column("text"), min_score)
            row, item, score, start, stop = zip(*got, strict=True) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array([shared.value.ids[i] for i in item], item_type), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return d.mapInArrow(find, f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, score double, start_word int, end_word int")


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no leak.

    No shuffle with a benchmark that is broadcast; else texts with a leak are left out by their digest.
    """
    d, (items, small) = id_and_text(docs, id_col, text_col), _items(benchmark, item_col, item_text)
    if not small:
        digest = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
        found = _joined(d.withColumn("key", F.sha2("text", 256)), items, min_score)
        keys = materialize(found.select("key").distinct(), "leaking")
        discard(found)
        return docs.join(keys, digest == keys["key"], "left_anti")
    shared = _shared(d, items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            mask = np.ones(b.num_rows, dtype=bool)
            mask[[m[0] for m in _matches(shared.value, pc.fill_null(b.column(text_col), ""), min_score)]] = False
            yield b.filter(pa.array(mask))

    return bounded_batches(docs).mapInArrow(keep, docs.schema)
