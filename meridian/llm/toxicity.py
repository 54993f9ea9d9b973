"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF on a block-max inverted index.

Every word of an example (lower-cased, without punctuation at its ends) is a term of its vector; none is
dropped.  A weight is (1 + log tf) * idf * relevance, unit length for each text.  The relevance of a term
lies between FLOOR and 1 and grows with the G-squared statistic of the term and the label, counted on one
example of each group of near copies; plain TF-IDF (relevance 1) finds about half of the toxic texts,
because a long text shares far more of its common words with clean texts than its few insults with toxic
ones.  Words that no example has don't change a ranking and are left out of a query's length.

Postings lie by term and then by example; neighbouring examples form blocks, and every pair of term and
block has the highest weight in it.  A search opens the blocks with the best bounds, and then every block
whose bound reaches the k-th best similarity found, so the k best are exact.

The vote is the share of toxic labels among the NEIGHBOURS nearest, weighted by similarity, with the
examples' share as PRIOR similarity besides; a logistic curve, fitted on a held-back fifth of the examples
and drawn towards the identity where there are few, turns it into the score.  The index then takes all
examples.  Evidence is the neighbours' ids and similarities.

Fitting uses labelled training rows only: at most MAX_EXAMPLES ids (those with the smallest hashes) and of
these, in that order, as many as have MAX_POSTINGS terms; so the model's size is bounded and it is
broadcast.  Labels, language, source and id are no inputs of a score.  Null and empty texts and texts
without a known word have the vote of the examples' share.  With no labelled training row every score is
0.  A repeated id counts once (the highest label; the least text hash); repeated rows get equal scores; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, coded, hashed, id_and_text, materialize, pack, ranges, slices, train_rows, unpack, words_of
from .jaccard_join import shingles

MAX_EXAMPLES = 4_000
MAX_POSTINGS = 2_000_000
NEIGHBOURS = 15
BLOCK = 128
#: Relevance is FLOOR + (1 - FLOOR) G / (G + HALF).
FLOOR, HALF = 0.02, 100.0
#: Similarity that the examples' share of toxic labels counts for in a vote.
PRIOR = 0.1
_EDGES = "[^\\p{L}\\p{N}]+"


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes of each text (sorted, distinct), their counts, and the number of terms of each text."""
    flat, counts = words_of(text)
    codes, words = coded(flat)
    bare = pc.replace_substring_regex(pc.utf8_lower(words), f"^{_EDGES}|{_EDGES}$", "")
    again, words = coded(bare)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    h = hashed(words)
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keep = np.asarray(pc.greater(pc.binary_length(words), 0), dtype=bool)[again[codes]]
    doc = np.repeat(np.arange(len(counts)), counts)[keep]
    key, tf = np.unique(doc * len(order) + rank[again[codes][keep]], return_counts=True)
    return h[order][key % len(order)], tf, np.bincount(key // len(order), minlength=len(counts))


class Index:
    """Block-max inverted index of unit vectors: postings by term and example, and blocks of a term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        # examples with the same heaviest shared term lie together, which keeps the blocks' bounds low
        df = np.bincount(term, minlength=n_terms)
        lead = np.full(n, n_terms, dtype=np.int64)
        by = np.lexsort((-weight * (df[term] > 1), doc))
        who, first = np.unique(doc[by], return_index=True)
        lead[who] = term[by][first]
        self.order = np.argsort(lead, kind="stable")  # example at each place
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        self.n, self.n_blocks = n, -(-n // BLOCK)
        doc = place[doc]
        by = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[by].astype(np.int32), weight[by].astype(np.float32), term[by]
        block = self.doc // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.at = np.append(at, len(term)).astype(np.int64)  # the first posting of each entry (term, block)
        self.block = block[at].astype(np.int32)
        self.high = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0, np.float32)
        self.entries = np.searchsorted(term[at], np.arange(n_terms + 1))  # the first entry of each term

    def _similar(self, entry: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Similarities of all examples, over the postings of these entries."""
        size = self.at[entry + 1] - self.at[entry]
        at = ranges(self.at[entry], size)
        return np.bincount(self.doc[at], np.repeat(weight, size) * self.weight[at], minlength=self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the k nearest with a positive similarity (ties: lower example)."""
        size = self.entries[terms + 1] - self.entries[terms]
        entry, weight = ranges(self.entries[terms], size), np.repeat(weights, size)
        if not len(entry):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        block = self.block[entry]
        bound = np.bincount(block, weight * self.high[entry], minlength=self.n_blocks)
        few = -(-k // BLOCK) + 2  # the blocks that are opened first
        if self.n_blocks > 2 * few:
            first = np.zeros(self.n_blocks, dtype=bool)
            first[np.argpartition(-bound, few)[:few]] = True
            use = first[block]
            sims = self._similar(entry[use], weight[use])
            least = np.partition(sims, -k)[-k] if self.n >= k else 0.0
            use = (bound >= least * (1 - 1e-5) - 1e-9)[block] & (bound > 0)[block]
            more = use & ~first[block]
            if more.any():
                sims += self._similar(entry[more], weight[more])
        else:
            sims = self._similar(entry, weight)
        at = np.flatnonzero(sims > 0)
        if len(at) > 4 * k:
            least = np.partition(sims[at], -k)[-k]
            at = at[sims[at] >= least - 1e-9]
        example = self.order[at]
        by = np.lexsort((example, -np.round(sims[at], 9)))[:k]
        return example[by], sims[at][by]


class Model:
    """Vocabulary (sorted hashes), term factors, index, labels and ids of the examples, and the curve."""

    def __init__(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ids: list, groups: np.ndarray):
        n, self.labels, self.ids, self.curve = len(labels), labels, ids, (1.0, 0.0)
        self.share = float(labels.mean()) if n else 0.0
        doc = np.repeat(np.arange(n), sizes)
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        one = np.zeros(n, dtype=bool)
        one[np.unique(groups, return_index=True)[1]] = True  # of each group of near copies
        n_pos, n_neg = float((labels[one] == 1).sum()), float((labels[one] == 0).sum())
        pos = np.bincount(term, one[doc] & (labels[doc] == 1), minlength=len(self.vocabulary)).astype(float)
        neg = np.bincount(term, one[doc] & (labels[doc] == 0), minlength=len(self.vocabulary)).astype(float)
        idf = np.log((n_pos + n_neg + 1) / (pos + neg + 1)) + 1
        self.factor = idf * relevance(pos, neg, n_pos, n_neg)
        weight = self._unit(doc, term, tf, n)
        self.index = Index(doc, term, weight, n, len(self.vocabulary))

    def _unit(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(tf)) * self.factor[term]
        return w / np.maximum(np.sqrt(np.bincount(doc, w * w, minlength=n))[doc], 1e-12)

    def votes(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Vote, neighbours (examples) and similarities of texts given by their bags."""
        n = len(sizes)
        if not len(self.labels):
            return np.zeros(n), [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        place = np.searchsorted(self.vocabulary, terms)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == terms if len(self.vocabulary) else np.zeros(len(terms), dtype=bool)
        doc, term = np.repeat(np.arange(n), sizes)[known], place[known]
        weight = self._unit(doc, term, tf[known], n)
        cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
        out, near, sims = np.empty(n), [], []
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            example, sim = self.index.nearest(term[a:b], weight[a:b], NEIGHBOURS)
            out[i] = (sim @ self.labels[example] + PRIOR * self.share) / (sim.sum() + PRIOR)
            near.append(example)
            sims.append(sim)
        return out, near, sims

    def scores(self, votes: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(votes))
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * logit(votes) + b)))


def relevance(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """FLOOR to 1 by the G-squared statistic of each term's document counts in the two classes."""

    def f(x):
        x = np.asarray(x, dtype=float)
        return x * np.log(np.where(x > 0, x, 1.0))

    n = n_pos + n_neg
    g = 2 * (f(pos) + f(neg) + f(n_pos - pos) + f(n_neg - neg) - f(pos + neg) - f(n - pos - neg) - f(n_pos) - f(n_neg) + f(n))
    g = np.maximum(g, 0.0)
    return FLOOR + (1 - FLOOR) * g / (g + HALF)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes' log odds, with a normal prior around (1, 0)."""
    x = np.stack([logit(votes), np.ones(len(votes))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (labels - p) - (at - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 0.05)), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int | None = 5, limit: int = MAX_EXAMPLES, postings: int = MAX_POSTINGS) -> Model:
    """The model of the labelled rows; with a modulus only of its training rows."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if modulus:
        lab = lab.where(train_rows("doc_id", modulus) != 0)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("id"), "toxic")
    rows = id_and_text(docs, "doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("id")).select("id", F.xxhash64("id").alias("rank"), "toxic", "text")  # at most limit ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES // 2):
            terms, tf, sizes = bags(b.column("text"))
            runs, n = shingles(b.column("text"), 3)
            least = np.zeros(b.num_rows, np.uint64)
            if len(runs):
                least[n > 0] = runs[(np.cumsum(n) - n)[n > 0]]  # sorted within a text
            ends = np.cumsum(sizes).tolist()
            cut = [(e - k, e) for e, k in zip(ends, sizes.tolist(), strict=True)]
            packed = [[pack(x[i:j]) for i, j in cut] for x in (terms, tf.astype(np.uint32))]
            whole = hashed(b.column("text")).view(np.int64)
            cols = [b.column("rank"), pa.array(whole), b.column("id").cast(pa.string()), b.column("toxic"), pa.array(sizes, pa.int64()), pa.array(least.view(np.int64)), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(cols, names=["rank", "whole", "id", "toxic", "n", "grp", "terms", "tf"])

    kind = "rank long, whole long, id string, toxic int, n long, grp long, terms binary, tf binary"
    one = rows.mapInArrow(run, kind).groupBy("rank", "id").agg(F.min(F.struct("whole", "toxic", "n", "grp", "terms", "tf")).alias("x")).select("rank", "id", "x.*")
    one = materialize(one, "examples")
    sizes = sorted((r["rank"], r["id"], r["n"]) for r in one.select("rank", "id", "n").collect())  # at most limit rows
    total, last = 0, None
    for rank, _, n in sizes:
        total += n
        if total > postings and last is not None:
            break
        last = rank
    got = one.where(F.col("rank") <= last).collect() if last is not None else []  # at most so many postings
    got.sort(key=lambda r: (r["rank"], r["id"]))

    def model(rows: list) -> Model:
        joined = [np.concatenate([unpack(r[k], t) for r in rows] or [np.zeros(0, t)]) for k, t in (("terms", np.uint64), ("tf", np.uint32))]
        return Model(*joined, np.array([r["n"] for r in rows], dtype=np.int64), np.array([int(r["toxic"] > 0) for r in rows], dtype=np.int64), [r["id"] for r in rows], np.array([r["grp"] for r in rows], dtype=np.int64))

    back = [r for i, r in enumerate(got) if i % 5 == 0]  # the order is that of a hash
    found = (1.0, 0.0)
    if back and len(got) > len(back):
        part = model([r for i, r in enumerate(got) if i % 5])
        votes, _, _ = part.votes(np.concatenate([unpack(r["terms"], np.uint64) for r in back]), np.concatenate([unpack(r["tf"], np.uint32) for r in back]), np.array([r["n"] for r in back]))
        found = curve(votes, np.array([int(r["toxic"] > 0) for r in back]))
        del part
    whole = model(got)
    whole.curve = found
    return whole


def _rate(model: Model, text: pa.Array) -> tuple[np.ndarray, list, list]:
    """Scores, neighbours and similarities of a batch of texts; equal texts are searched once."""
    which, texts = coded(text)
    votes, near, sims = model.votes(*bags(texts))
    out = model.scores(votes)
    return out[which], [near[i] for i in which], [sims[i] for i in which]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence_ids, evidence_labels, evidence_sims for every row."""
    d = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_EXAMPLES and MAX_POSTINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text", SLICE_BYTES):
            out, near, sims = _rate(model, b.column("text"))
            ids, marks = [[model.ids[i] for i in x] for x in near], [model.labels[x].tolist() for x in near]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array(ids, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32())), pa.array([x.tolist() for x in sims], pa.list_(pa.float64()))], names=["doc_id", "score", "evidence_ids", "evidence_labels", "evidence_sims"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, score double, evidence_ids array<string>, evidence_labels array<int>, evidence_sims array<double>")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            out, _, _ = _rate(shared.value, pc.fill_null(b.column(text_col), ""))
            yield b.filter(pa.array(out < threshold))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
