"""N-gram Jaccard join by chosen paths.

Sets are the hashes of a text's five-word shingles (a shorter text with words is one shingle; a text
without words has no shingles and no links).  Documents with equal sets form one class and are joined
once.  Every class has a sketch of min-hash tokens.  In each run a class follows paths: a node, named
by its path, samples one coordinate of the sketch (and a second one with chance 1 / threshold - 1) and
the node's sets are split by the token found there, so sets go on together only by sampled tokens that
they share.  A node with at most SMALL sets is brute-forced on the sketches; a larger one is split
again, up to DEPTH times, and what is still together then (near copies by the hundred) is kept
together whole.  Runs are repeated until a pair at the threshold is missed with a chance of at most
1 - recall.

What is together in a node joins candidate families (connected components).  Inside a family every
pair whose sizes allow it is compared exactly, in blocks of sets, so a family of any size is many
small tasks and no pair ever becomes a row: a block pair returns a degree for each set and spanning
links.  Final classes are the components of exact links.

Null ids are kept and never drop a row; repeated rows belong to one class; columns of any name pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, coded, discard, estimated_bytes, hashed, id_and_text, materialize, mix, pack, slices, unpack, words_of

WORDS = 5
THRESHOLD = 0.8
SKETCH = 64
DEPTH = 4
SMALL = 48
RECALL = 0.999
#: Sketch agreement below which a brute-forced pair isn't a candidate (6 deviations under 0.8).
AGREE = 0.5
#: Sets, and bytes of their shingles, in a block of a family, about.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Bytes of a written table of nodes' minima up to which it is broadcast.
FEW_BYTES = 1 << 20


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold meets at the given depth with the given chance."""
    meet, extra = 1.0, min(1.0, 1 / threshold - 1)
    for _ in range(depth):
        meet = 1 - (1 - threshold * meet) * (1 - extra * threshold * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingles(text: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their counts."""
    flat, counts = words_of(text)
    codes, words = coded(flat)
    word = hashed(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(counts, counts)
    h = np.zeros(len(word), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):  # a short text's only shingle takes the words that it has
            nxt = np.zeros(len(word), dtype=np.uint64)
            if k < len(word):
                nxt[: len(word) - k] = word[k:]
            nxt[at + k >= size] = k
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt)
    keep = (at + n <= size) | ((at == 0) & (size < n))
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def sketches(h: np.ndarray, counts: np.ndarray, t: int = SKETCH) -> np.ndarray:
    """t min-hash values (unsigned 32 bits) of every non-empty set."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 62, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, t, dtype=np.uint64)
    start = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(start), t), dtype=np.uint32)
    if len(start):
        with np.errstate(over="ignore"):
            for i in range(t):
                out[:, i] = np.minimum.reduceat(((h * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, set_id (16 bytes; null without words), n_shingles, sketch."""
    d = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            h, counts = shingles(b.column("text"))
            sk, j = sketches(h, counts), 0
            ids, sketch, e = [], [], 0
            for n in counts.tolist():
                e += n
                ids.append(xxhash.xxh3_128_digest(h[e - n : e].tobytes()) if n else None)
                sketch.append(sk[j].tobytes() if n else None)
                j += n > 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids, pa.binary()), pa.array(counts, pa.int32()), pa.array(sketch, pa.binary())], names=["doc_id", "text_hash", "set_id", "n_shingles", "sketch"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, text_hash long, set_id binary, n_shingles int, sketch binary")


def _extend(paths: DataFrame, threshold: float, t: int = SKETCH) -> DataFrame:
    """Split every node by the tokens at its sampled coordinates; paths: path, set_id, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path = np.asarray(b.column("path")).astype(np.int64).view(np.uint64)
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(-1, t)
            with np.errstate(over="ignore"):
                seeds = [mix(path + np.uint64(s)) for s in (0x51, 0x52, 0x53)]
                some = (seeds[2] >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / threshold - 1
                rows = [np.arange(b.num_rows), np.flatnonzero(some)]
                new = []
                for r, s in zip(rows, seeds, strict=False):
                    c = (s[r] % np.uint64(t)).astype(np.int64)
                    new.append(mix(mix(path[r] ^ (s[r] << np.uint64(1))) + sk[r, c].astype(np.uint64)))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(new).view(np.int64)), b.column("set_id").take(at)], names=["path", "set_id"])

    return paths.select("path", "set_id", "sketch").mapInArrow(run, "path long, set_id binary")


def _links(nodes: DataFrame, agree: float = AGREE, t: int = SKETCH) -> DataFrame:
    """Spanning candidate links of small nodes (members: array of set_id and sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for members in b.column("members").to_pylist():
                ids = [m["set_id"] for m in members]
                sk = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint32).reshape(-1, t)
                near = (sk[:, None, :] == sk[None, :, :]).mean(axis=2) >= agree
                for i, j in spanning(near):
                    u.append(ids[i])
                    v.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return nodes.select("members").mapInArrow(run, "u binary, v binary")


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given by a square matrix."""
    n, out = len(near), []
    todo = np.ones(n, dtype=bool)
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(near[i] & todo)
            todo[new] = False
            out += [(i, j) for j in new.tolist()]
            stack += new.tolist()
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node of its component) for every node of links (u, v).

    Large-star and small-star steps in turn; each halves the distances, so a few rounds do.  The centre of
    a large component has many edges: minima are aggregated before the shuffle and written first, so that
    the join with the edges is plain and Spark's skew handling can split a centre's edges over tasks.
    Minima of few nodes are broadcast, which leaves the edges where they are.  Edges lead to the lesser
    node, so a round that leaves stars only is the last.
    """

    def few(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if 0 < estimated_bytes(t) <= FEW_BYTES else t

    edges = materialize(links.where(F.col("u") != F.col("v")).distinct(), name)
    while True:
        # large star: larger neighbours of a node are hung on its least neighbour
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = both.where(F.col("v") > F.col("u")).join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large, name)  # at most a row for each edge
        # small star: a node's smaller neighbours are hung on the least of them
        low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), name)
        small = down.join(few(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(edges, least, down, low)
        edges = new
        ends = new.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        if not ends.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))).agg(F.count("*")).first()[0]:
            roots = new.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def families(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """node, root: classes that met on a path, in connected components; lone classes are left out."""
    spark = classes.sparkSession
    sk = classes.select("set_id", "sketch")
    runs = spark.range(runs_for(recall, threshold)).select(F.xxhash64("id").alias("path"))
    paths = sk.crossJoin(F.broadcast(runs))  # a fixed number of runs
    found, steps = None, []
    for depth in range(1, DEPTH + 1):
        step = materialize(_extend(paths, threshold), "paths")
        steps.append(step)
        size = step.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = step.join(size, "path")
        members = met.where(F.col("n") <= SMALL).join(sk, "set_id").groupBy("path").agg(F.collect_list(F.struct("set_id", "sketch")).alias("members"))
        new = _links(members)
        if depth == DEPTH:  # still together: linked whole, to the least of them
            large = met.where(F.col("n") > SMALL)
            hub = large.groupBy("path").agg(F.min("set_id").alias("v"))
            new = new.union(large.join(hub, "path").select(F.col("set_id").alias("u"), "v"))
        found = new if found is None else found.union(new)
        paths = met.where(F.col("n") > SMALL).select("path", "set_id").join(sk, "set_id")
    out = components(found, "families")
    discard(*steps)
    return out


def near_sets(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of a are at or above the threshold with which of b (None: a itself, but not with itself)."""
    both = [*a, *(b or [])]
    sizes = np.array([len(x) for x in both], dtype=np.int64)
    tokens, inverse, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    width = int(shared.sum())
    keep = shared[inverse]
    row, col = np.repeat(np.arange(len(both)), sizes)[keep], place[inverse][keep]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    na, nb = sizes[: len(a)], sizes[len(a) :] if b is not None else sizes
    inter = np.zeros((len(na), len(nb)), dtype=np.float32)
    for lo in range(0, width, 2048):  # a strip of tokens at a time bounds the memory
        i, j = np.searchsorted(col, (lo, lo + 2048))
        m = np.zeros((len(both), min(2048, width - lo)), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m[: len(a)] @ (m.T if b is None else m[len(a) :].T)
    near = inter >= threshold * (na[:, None] + nb[None, :] - inter) - 1e-4
    if b is None:
        np.fill_diagonal(near, False)
    return near


BLOCK_ROW = "root binary, block int, blocks int, ids binary, n_rows binary, sizes binary, tokens binary"
LINK_ROW = "set_id binary, links long, classes long, u binary, v binary"


def _links_of(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["set_id", "links", "classes", "u", "v"])


def _found(near: np.ndarray, a: list[bytes], rows_a: np.ndarray, b: list[bytes] | None, rows_b: np.ndarray) -> list[tuple]:
    """LINK_ROW rows: degrees of sets, and spanning links."""
    out = []
    sides = [(a, near @ rows_b, near.sum(1))] + ([(b, near.T @ rows_a, near.sum(0))] if b is not None else [])
    for ids, links, classes in sides:
        out += [(s, x, y, None, None) for s, x, y in zip(ids, links.tolist(), classes.tolist(), strict=True) if y]
    if b is None:
        return out + [(None, None, None, a[x], a[y]) for x, y in spanning(near)]
    whole = np.zeros((len(a) + len(b),) * 2, dtype=bool)
    whole[: len(a), len(a) :] = near
    whole |= whole.T
    names = a + b
    return out + [(None, None, None, names[x], names[y]) for x, y in spanning(whole)]


def verified(classes: DataFrame, fam: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """set_id, links (rows), classes (linked classes), u, v rows: degrees of sets and spanning links.

    A set is shuffled once, to its block, which is compared with itself there; only blocks of larger families
    go on, one row each, to meet the family's other blocks.
    """
    member = classes.join(fam.withColumnRenamed("node", "set_id"), "set_id").select("set_id", "root", "n_rows", "n_shingles", "doc_id", "text_hash")
    per = materialize(member.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.col("n_shingles").cast("long") * 8).alias("b")), "family-sizes")
    member = member.join(per, "root")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("b") / BLOCK_BYTES)).cast("int")
    member = member.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("set_id"), blocks).cast("int")})
    # one row of each class brings its text
    text = id_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "_id")
    rows = member.join(text, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash")))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            h, counts = shingles(b.column("text"))
            ends = np.cumsum(counts)
            raw = [h[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("set_id"), b.column("root"), b.column("block"), b.column("blocks"), b.column("n_rows"), pa.array(raw, pa.binary())], names=["set_id", "root", "block", "blocks", "n_rows", "tokens"])

    loaded = rows.select("set_id", "root", "block", "blocks", "n_rows", "text").mapInArrow(load, "set_id binary, root binary, block int, blocks int, n_rows long, tokens binary")

    def inside(t: pa.Table) -> pa.Table:
        d = {k: t.column(k).to_pylist() for k in ("set_id", "n_rows", "tokens")}
        got = {s: k for k, s in enumerate(d["set_id"])}  # repeated rows of one class count once
        ids = sorted(got)
        sets = [np.frombuffer(d["tokens"][got[s]], np.uint64) for s in ids]
        n_rows = np.array([d["n_rows"][got[s]] for s in ids], dtype=np.int64)
        out = _links_of(_found(near_sets(sets, None, threshold), ids, n_rows, None, n_rows))
        packed = pa.nulls(out.num_rows, pa.binary())
        cols = {"root": packed, "block": pa.nulls(out.num_rows, pa.int32()), "blocks": pa.nulls(out.num_rows, pa.int32()), "ids": packed, "n_rows": packed, "sizes": packed, "tokens": packed}
        if (n := t.column("blocks")[0].as_py()) > 1:
            row = {"root": t.column("root")[0].as_py(), "block": t.column("block")[0].as_py(), "blocks": n, "ids": b"".join(ids), "n_rows": n_rows.tobytes(), "sizes": np.array([len(x) for x in sets], dtype=np.int64).tobytes(), "tokens": pack(np.concatenate(sets))}
            out = pa.concat_tables([out, _links_of([(None,) * 5])])
            cols = {k: pa.concat_arrays([v, pa.array([row[k]], v.type)]) for k, v in cols.items()}
        for k, v in cols.items():
            out = out.append_column(k, v)
        return out

    own = materialize(loaded.groupBy("root", "block").applyInArrow(inside, f"{LINK_ROW}, {BLOCK_ROW}"), "blocks")
    names = ["set_id", "links", "classes", "u", "v"]
    # each block meets every other block of its family
    b = own.where(F.col("root").isNotNull())
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = b.withColumn("p", F.explode(pair)).select("root", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "ids", "n_rows", "sizes", "tokens")

    def across(t: pa.Table) -> pa.Table:
        sides = []
        for r in sorted(t.select(["block", "ids", "n_rows", "sizes", "tokens"]).to_pylist(), key=lambda r: r["block"]):
            sizes, tokens = np.frombuffer(r["sizes"], np.int64), unpack(r["tokens"], np.uint64)
            sides.append(([r["ids"][k : k + 16] for k in range(0, len(r["ids"]), 16)], np.frombuffer(r["n_rows"], np.int64), np.split(tokens, np.cumsum(sizes)[:-1])))
        if len(sides) < 2:  # the other block is empty
            return _links_of([])
        (a, rows_a, sets_a), (c, rows_c, sets_c) = sides
        return _links_of(_found(near_sets(sets_a, sets_c, threshold), a, rows_a, c, rows_c))

    return own.where(F.col("root").isNull()).select(*names).union(dealt.groupBy("root", "i", "j").applyInArrow(across, LINK_ROW))


def _joined(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs, with class_key: the component (null without words)."""
    all_sets = materialize(sets(docs, id_col, text_col), "sets")
    # the class of equal sets: one row each (its sketch is the same in every row)
    classes = all_sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.count("*").alias("n_rows"), F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select("set_id", "n_rows", "n_shingles", "least.doc_id", "least.text_hash", "sketch"), "classes")
    fam = families(classes, threshold, recall)
    found = materialize(verified(classes, fam, docs, threshold, id_col, text_col), "links")
    degree = found.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.sum("links").alias("links"))
    comp = components(found.where(F.col("u").isNotNull()).select("u", "v"), "joined").withColumnRenamed("node", "set_id")
    about = classes.select("set_id", "doc_id", "n_rows").join(comp, "set_id", "left").join(degree, "set_id", "left")
    # written before they meet: a plain join, so a large class can be split over tasks
    about = materialize(about.withColumn("class_key", F.coalesce("root", "set_id")), "class-sets")
    least = materialize(about.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "class-ids")
    about = about.select("set_id", "class_key", "n_rows", F.coalesce("links", F.lit(0)).alias("links")).join(least, "class_key")
    return all_sets.drop("sketch").join(about, "set_id", "left")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, n_copies, n_shingles.

    class_id: the least id of the component; n_links: other rows at or above the threshold, copies
    included; n_copies: rows with the same set, itself included.
    """
    return _joined(docs, threshold, recall, id_col, text_col).select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n_rows") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_copies"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class (the least id); rows without words all stay."""
    found = materialize(_joined(docs, threshold, recall, id_col, text_col).select("doc_id", "text_hash", "class_key"), "joined-rows")
    first = found.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    keep = first.select("k.*").union(found.where(F.col("class_key").isNull()).select("doc_id", "text_hash").distinct())
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = F.btrim(text, F.lit(" \t\n\x0b\f\r")) != ""
    # whole rows in one column, so that no name of theirs meets one of ours
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h"), worded.alias("worded"))
    out = at.join(keep, at["i"].eqNullSafe(keep["doc_id"]) & (at["h"] == keep["text_hash"]), "left_semi")
    again = found.where(F.col("class_key").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if again.limit(1).count():  # the same row more than once
        out = out.where("worded").dropDuplicates(["i", "h"]).union(out.where("not worded"))
    return out.select("row.*")
