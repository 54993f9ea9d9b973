"""Language-model scoring with a gated recurrent network.

The words of all training documents are counted by a global distinct-word shuffle.  Frequent words are
predicted by a class-factored softmax (a class from the state, then a word inside the class); every
other seen word belongs to a tail class and has its share of the class's count; the rare class holds
the words seen at most once and the one unknown word, whose share follows Good and Turing.  The
probabilities of all seen words and the unknown word add up to 1 at every place.

Counts, frequent words, tail classes and rare shares come from all training documents, and the network
(numpy, truncated backpropagation, Adam) is fitted on all of them too, each once (SHARE is 1; README: what
a share buys, and what all cost).  Their codes are dealt over
ROUNDS rounds of tasks of about TASK_TOKENS; each task goes on from the round's common network, and the
round's networks are averaged by their tokens.  One task's codes start the network where there are several.
Scoring carries the state across windows from a document's first word to its end token, so it is the
whole text's log-likelihood.

Null and empty texts are one end token.  A null id is a training row.  Without training documents
every probability is 1 over one unknown word.  Repeated rows count and score each; an empty table
gives an empty table.
"""

from __future__ import annotations

import copy
import functools
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import binaries, coded, dealt, id_and_text, keep_pages, materialize, pack, ranges, release, train_rows, unpack, words_of

END = "\n"
#: Tokens that a training task holds, and that a row of training codes holds at least (or all of a block).
TASK_TOKENS = 1_200_000
PIECE_TOKENS = 32_768
#: Frequent words, classes of frequent words, endings (tail classes), sizes.
TOP = 2_048
CLASSES = 48
ENDINGS = 16
HIDDEN, EMBED = 32, 24
#: Rows of the class softmax that are worked on at a time, so that they stay in a core's cache.
ROWS = 1_024
STREAMS, STEPS, EPOCHS, RATE = 256, 16, 1, 0.012
#: One in so many training documents trains the network (all), in so many rounds of averaging.
SHARE, ROUNDS = 1, 2
SMOOTH = 0.1


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased (A to Z) words of each text and one end token after them."""
    keep_pages()
    flat, counts = words_of(pc.ascii_lower(text))
    codes, words = coded(flat)
    words = pa.concat_arrays([words, pa.array([END], words.type)])
    ends = np.cumsum(counts)
    return words, np.insert(codes, ends, len(words) - 1), counts + 1


def ending(word: bytes) -> int:
    """The tail class of a word: a hash of its last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


@functools.cache
def _pairs() -> np.ndarray:
    """Tail classes of words by their last two bytes as a number; then the empty word's; then words' of one byte."""
    return np.array([ending(bytes(divmod(i, 256))) for i in range(1 << 16)] + [ending(b"")] + [ending(bytes([i])) for i in range(256)], dtype=np.int64)


def endings(words: pa.Array) -> np.ndarray:
    """The tail class of each word."""
    raw, offsets = binaries(words)
    if not len(raw):
        return np.full(len(words), ending(b""))
    n, last = np.diff(offsets), offsets[1:] - 1
    a, b = raw[np.maximum(last - 1, 0)].astype(np.int64), raw[np.maximum(last, 0)].astype(np.int64)
    return _pairs()[np.where(n > 1, a * 256 + b, np.where(n == 1, b + 65_537, 65_536))]


class Network:
    """Embedding, gated recurrent unit, class softmax, softmax inside the classes."""

    def __init__(self, sizes: list[int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sizes = sizes  # of the classes of frequent words
        n = sum(sizes)
        self.n_codes = n + 2 * ENDINGS
        self.first = np.cumsum([0, *sizes])[:-1]
        self.class_of = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(ENDINGS), np.full(ENDINGS, len(sizes) + ENDINGS)]).astype(np.int64)
        self.n_classes, self.n_top = len(sizes) + ENDINGS + 1, n
        # classes of about the same size are worked on together: their numbers, their words (filled up to the largest), which of these are real
        self.groups, wide = [], [k for k in sorted(range(len(sizes)), key=lambda k: sizes[k]) if sizes[k] > 1]  # the only word of its class is certain
        while wide:
            some = [k for k in wide if sizes[k] <= 2 * sizes[wide[0]]]
            wide, at = wide[len(some) :], np.arange(sizes[some[-1]])
            real = at < np.array([sizes[k] for k in some])[:, None]
            self.groups.append((np.array(some), np.where(real, self.first[some][:, None] + at, 0), real))
        f = np.float32

        def normal(*shape):
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(f)

        self.p = {"E": normal(self.n_codes, EMBED) * 3, "Wx": normal(EMBED, 3 * HIDDEN), "Wh": normal(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, f), "C": normal(HIDDEN, self.n_classes) * f(0.1), "c": np.zeros(self.n_classes, f), "W": normal(HIDDEN, max(n, 1)) * f(0.1), "w": np.zeros(max(n, 1), f)}

    def start(self, counts: np.ndarray) -> None:
        """Output biases from the counts of codes in the sample."""
        cls = np.bincount(self.class_of, counts, minlength=self.n_classes)
        self.p["c"][:] = np.log((cls + 1) / (cls.sum() + self.n_classes))
        if self.n_top:
            self.p["w"][:] = np.log(counts[: self.n_top] + 0.5)

    def gates(self, *names: str) -> np.ndarray:
        """Rows of weights apart for each gate (update, reset, new), of which the first two have the sign that their exponentials take."""
        rows = np.vstack([self.p[k].reshape(-1, 3 * HIDDEN) for k in names])
        out = np.ascontiguousarray(rows.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
        np.negative(out[:2], out=out[:2])
        return out

    def embedded(self) -> np.ndarray:
        """The embedding of each code and a 1 for the bias."""
        return np.concatenate([self.p["E"], np.ones((self.n_codes, 1), self.p["E"].dtype)], 1)

    def inputs(self) -> np.ndarray:
        """What each code adds to each of the gates (see gates)."""
        return self.embedded() @ self.gates("Wx", "b")

    def states(self, x: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: dict | None = None, gx: np.ndarray | None = None) -> np.ndarray:
        """States before each token of x (steps, streams); fresh marks tokens that begin a document; gx: inputs(), if at hand.

        A gate's values of a step lie together, so that each operation runs over one piece of memory.
        """
        H, wh = HIDDEN, self.gates("Wh")
        gx = self.inputs() if gx is None else gx
        out = np.empty((len(x) + 1, x.shape[1], H), h.dtype)
        out[0] = h
        # update and reset gate, new value, its share from the state, update gate times (state - new value)
        held = np.empty((1 if keep is None else len(x), 5, x.shape[1], H), h.dtype)
        begin = np.zeros(len(x), dtype=bool) if fresh is None else fresh.any(1)
        for t in range(len(x)):
            h, now = out[t], held[0 if keep is None else t]
            if begin[t]:
                h[fresh[t] > 0] = 0
            a = np.take(gx, x[t], axis=1)
            zr, n, u, rest = now[:2], now[2], now[3], now[4]
            np.matmul(h, wh[:2], out=zr)
            zr += a[:2]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.matmul(h, wh[2], out=u)
            np.multiply(zr[1], u, out=n)
            n += a[2]
            np.tanh(n, out=n)
            np.subtract(h, n, out=rest)
            rest *= zr[0]
            np.add(rest, n, out=out[t + 1])
        if keep is not None:
            keep["held"] = held
        self.last = out[-1].copy()
        return out[:-1]

    def logs(self, s: np.ndarray, y: np.ndarray, grad: bool = False):
        """Natural log probability of each target code (a tail code: of its class); with gradients of the sum."""
        p = self.p
        cls = self.class_of[y]
        # rows in the order of classes, so that each class is a run of them
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(len(self.sizes) + 1))
        s, y, cls = np.take(s, order, axis=0), y[order], cls[order]
        got = np.empty(len(y), s.dtype)
        ds, g = (np.empty_like(s), {"C": np.zeros_like(p["C"]), "c": np.zeros_like(p["c"]), "w": np.zeros_like(p["w"])}) if grad else (None, None)
        back = np.ascontiguousarray(p["C"].T)
        for lo in range(0, len(y), ROWS):
            some = slice(lo, lo + ROWS)
            e = s[some] @ p["C"]
            e += p["c"]
            at = np.arange(len(e)) * e.shape[1] + cls[some]
            hit = e.ravel()[at]
            if not (e.max() < 60 and hit.min() > -60):
                e -= e.max(1, keepdims=True)
                hit = e.ravel()[at]
            np.exp(e, out=e)
            z = e @ np.ones(e.shape[1], e.dtype)
            got[some] = hit - np.log(z)
            if grad:
                e *= (-1 / z)[:, None]
                e.ravel()[at] += 1
                g["C"] += s[some].T @ e
                g["c"] += np.ones(len(e), e.dtype) @ e
                np.matmul(e, back, out=ds[some])
        words = np.ascontiguousarray(p["W"].T)
        gw = np.zeros_like(words)
        for k, cols, real in self.groups:
            n = edge[k + 1] - edge[k]
            at = edge[k][:, None] + np.arange(n.max())
            use = at < edge[k + 1][:, None]
            if not use.any():
                continue
            i, at = at[use], np.minimum(at, len(y) - 1)
            w, own = words[cols], s[at]
            e = own @ w.transpose(0, 2, 1)
            e += np.where(real, p["w"][cols], e.dtype.type(-1e9))[:, None]
            j = np.where(use, y[at] - self.first[k][:, None], 0)
            j = np.arange(j.size) * e.shape[2] + j.ravel()
            hit = e.ravel()[j]
            if not (e.max() < 60 and hit.min() > -60):
                e -= e.max(2, keepdims=True)
                hit = e.ravel()[j]
            np.exp(e, out=e)
            z = e @ np.ones(e.shape[2], e.dtype)
            got[i] += (hit.reshape(use.shape) - np.log(z))[use]
            if grad:
                e *= np.where(use, -1 / z, 0)[:, :, None].astype(e.dtype)
                e.ravel()[j] += use.ravel()
                gw[cols[real]] = (e.transpose(0, 2, 1) @ own)[real]
                g["w"][cols[real]] = e.sum(1)[real]
                ds[i] += (e @ w)[use]
        if grad:
            g["W"] = gw.T
        out = np.empty_like(got)
        out[order] = got
        if not grad:
            return out
        back = np.empty_like(ds)
        back[order] = ds
        return out, back, g

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the sum of log probabilities of y over a window that begins in state h."""
        p, H = self.p, HIDDEN
        keep: dict = {}
        embedded = self.embedded()
        s = self.states(x, h, fresh, keep, embedded @ self.gates("Wx", "b"))
        _, ds, g = self.logs(s.reshape(-1, H), y.ravel(), True)
        ds = ds.reshape(s.shape)
        # gradients of the new value, the update and the reset gate (of these three the inputs'), and the state's share of the new value
        ga = np.empty((4, *s.shape), s.dtype)
        dh, some, back = np.zeros_like(h), np.empty_like(h), np.empty((3, *h.shape), h.dtype)
        wh = np.ascontiguousarray(p["Wh"].reshape(H, 3, H).transpose(1, 2, 0))
        begin = fresh.any(1)
        for t in range(len(x) - 1, -1, -1):
            (z, r, n, u, rest), (dn, dz, dr, du) = keep["held"][t], ga[:, t]
            np.subtract(1, z, out=some)
            np.multiply(rest, some, out=dz)
            dz *= dh
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= some
            dn *= dh
            np.multiply(dn, r, out=du)
            np.subtract(1, r, out=some)
            some *= u
            np.multiply(some, du, out=dr)
            np.matmul(ga[1:, t], wh, out=back)
            dh *= z
            dh += back[0]
            dh += back[1]
            dh += back[2]
            dh += ds[t]
            if begin[t]:
                dh[fresh[t] > 0] = 0

        def summed(left: np.ndarray, right: np.ndarray, order: tuple) -> np.ndarray:
            """Products of a window's rows with their gradients of three gates, added up step by step; the gates in this order."""
            return np.matmul(left.transpose(0, 2, 1), right).sum(1)[order, :].transpose(1, 0, 2).reshape(left.shape[2], -1)

        g["Wh"] = summed(s, ga[1:], (0, 1, 2))
        inputs = summed(np.take(embedded, x, axis=0), ga[:3], (1, 2, 0))
        g["Wx"], g["b"] = inputs[:-1], inputs[-1]
        # what comes to each place's embedding, added up by code; a complex number holds two columns, which halves the calls
        each = np.matmul(ga[:3].reshape(3, -1, H), np.ascontiguousarray(p["Wx"].reshape(EMBED, 3, H)[:, (2, 0, 1)].transpose(1, 2, 0)))
        each[0] += each[1]
        each[0] += each[2]
        codes = x.ravel()
        order = np.argsort(codes.astype(np.uint16), kind="stable")
        codes = codes[order]
        at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        g["E"] = np.zeros_like(p["E"])
        g["E"][codes[at]] = np.add.reduceat(np.take(each[0], order, axis=0).view(np.result_type(each, np.complex64)), at, axis=0).view(each.dtype)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, last: float = 0.0) -> None:
        """Truncated backpropagation over x, y (places, streams): the state goes on, gradients stop at windows.

        Adam; the rate falls from rate to last.
        """
        shape = [(k, v.shape) for k, v in self.p.items()]
        flat = np.concatenate([v.ravel() for v in self.p.values()])  # all weights as one vector, of which p has views
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: v.reshape(n) for (k, n), v in zip(shape, np.split(flat, cuts), strict=True)}
        m, v2 = np.zeros_like(flat), np.zeros_like(flat)
        step, total = 0, epochs * -(-len(x) // STEPS)
        for _ in range(epochs):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for a in range(0, len(x), STEPS):
                xs, ys, fs = x[a : a + STEPS], y[a : a + STEPS], fresh[a : a + STEPS]
                g = self.gradients(xs, ys, fs, h)
                h = self.last
                step += 1
                lr = (rate + (last - rate) * step / (total + 1)) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                q = np.concatenate([g[k].ravel() for k, _ in shape])
                scale = 1.0 / ys.size
                norm = math.sqrt(float(q @ q)) * scale
                q *= np.float32(scale * min(1.0, 1.0 / max(norm, 1e-9)))
                m *= np.float32(0.9)
                m += np.float32(0.1) * q
                q *= q
                v2 *= np.float32(0.999)
                q *= np.float32(0.001)
                v2 += q
                np.sqrt(v2, out=q)
                q += np.float32(1e-8)
                np.divide(m, q, out=q)
                q *= np.float32(lr)
                flat += q


class Model:
    """Counts and network: codes of words, and log10 probabilities of tail words."""

    def __init__(self, n: int, v: int, n1: int, n2: int, tail: np.ndarray, top: dict[bytes, int], network: Network | None):
        self.n, self.v, self.n1, self.n2, self.tail, self.top, self.network = n, v, n1, n2, tail, top, network
        self.trained = 0  # tokens that the network was trained on
        # the rare class: the unknown word's share, and each once-seen word's
        self.unknown = (n1 + 0.5) / (n1 + 2 * n2 + 1.0) if n1 else 1.0
        self.once = (1 - self.unknown) / n1 if n1 else 0.0

    def code(self, word: bytes, count: int) -> int:
        k = self.top.get(word)
        return k if k is not None else len(self.top) + (ENDINGS if count <= 1 else 0) + ending(word)

    def codes(self, words: pa.Array, count: np.ndarray) -> np.ndarray:
        """The code of each word."""
        found = pc.index_in(words, pa.array(list(self.top), words.type))
        k = np.asarray(found.fill_null(-1), dtype=np.int64)
        return np.where(k >= 0, k, len(self.top) + np.where(count <= 1, ENDINGS, 0) + endings(words))

    def tail_logs(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; 0 for frequent words."""
        t, out = len(self.top), np.zeros(len(code))
        mid = (code >= t) & (code < t + ENDINGS)
        out[mid] = np.log10(count[mid] / self.tail[code[mid] - t])
        rare = code >= t + ENDINGS
        out[rare] = np.where(count[rare] == 0, math.log10(self.unknown), math.log10(self.once) if self.once else 0.0)
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))


def counted(dicts: DataFrame, buckets: int) -> DataFrame:
    """Dictionary rows with the words' counts over all blocks, and a row of statistics for each task.

    Statistics (block null): packed sums (N, V, n1, n2, then the count of each ending's words seen
    twice or more), and the task's TOP most frequent words with their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.select(["block", "start", "n", "lens", "words", "counts"]).to_pylist()]  # packed: the bucket's dictionaries, of a size that the number of buckets sets
        words, each = blocks.joined_words([r["lens"] for r in held], [r["words"] for r in held])
        codes, words = coded(words)
        total = np.bincount(codes, np.concatenate([np.zeros(0), *(unpack(r["counts"], np.uint32) for r in held)]), len(words))  # whole numbers, exact up to 2**53
        if total.max(initial=0) >= 1 << 32:
            raise OverflowError("a word has more places than 32 bits can count")
        total = total.astype(np.int64)
        names = ["block", "start", "n", "lens", "words", "counts"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        ends = np.cumsum(each)
        for i in range(0, len(held), 64):
            some = held[i : i + 64]
            for r, lo, hi in zip(some, (ends - each)[i : i + 64], ends[i : i + 64], strict=True):
                r["counts"] = pack(total[codes[lo:hi]].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in zip(names, types, strict=True)], names=names)
        twice = total >= 2
        sums = np.concatenate([[total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.bincount(endings(words)[twice], total[twice], ENDINGS)]).astype(np.int64)
        # the words that may be among the most frequent: those with the TOP-th count or more
        least = max(3, int(np.partition(total, -TOP)[-TOP])) if len(total) > TOP else 3
        some = np.flatnonzero(total >= least)
        count = dict(zip(words.take(pa.array(some)).to_pylist(), total[some].tolist(), strict=True))
        mine = frequent(count)
        lens, raw = blocks.pack_words(pa.array(mine, pa.binary()))
        row = [None, None, None, lens, raw, pack(np.concatenate([sums, np.array([count[w] for w in mine], dtype=np.int64)]))]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return dicts.repartition(buckets, "bucket").mapInArrow(run, "block long, start int, n int, lens binary, words binary, counts binary")


def frequent(count: dict[bytes, int]) -> list[bytes]:
    """The TOP most frequent words (ties: lower word) among those seen three times or more."""
    return heapq.nsmallest(TOP, (w for w, c in count.items() if c >= 3), key=lambda w: (-count[w], w))


def untrained(total: np.ndarray, count: dict[bytes, int]) -> Model:
    """The model from the statistics of all training words and the frequent words' counts, its network not trained yet."""
    chosen = frequent(count)
    each = np.array([count[w] for w in chosen], dtype=np.int64)
    # classes of about equal mass
    share, edges = np.cumsum(each), []
    if chosen:
        k = min(CLASSES, len(chosen))
        edges = np.searchsorted(share, share[-1] * np.arange(1, k) / k, side="left").tolist()
    cuts = sorted({0, *edges, len(chosen)})
    tail = total[4:].copy()
    for w in chosen:
        tail[ending(w)] -= count[w]
    n1, n2 = int(total[2]), int(total[3])
    model = Model(int(total[0]), int(total[1]), n1, n2, np.maximum(tail, 1), {w: j for j, w in enumerate(chosen)}, None)
    if model.n:
        model.network = Network([b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        # words seen once or twice train as rare ones (see own)
        rare = np.zeros(ENDINGS)
        rare[0] = n1 + 2 * n2
        middle = np.maximum(tail, 0) * (1 - min(1.0, 2 * n2 / max(int(tail.sum()), 1)))
        model.network.start(np.concatenate([each, middle, rare]))
    return model


def own(model: Model, code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Leave one out: a training word is as rare as it would be without this place."""
    return code + np.where((count == 2) & (code >= len(model.top)) & (code < len(model.top) + ENDINGS), ENDINGS, 0)


def learn(net: Network, y: np.ndarray, sizes: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, last: float = 0.0) -> None:
    """Train on the codes y of documents of these sizes, side by side in streams; every place is used."""
    keep_pages()
    fresh = np.zeros(len(y), np.float32)
    fresh[np.cumsum(sizes) - sizes] = 1
    width = max(1, min(STREAMS, len(y) // STEPS))
    n = -(-len(y) // width)
    y, fresh = (np.resize(a, n * width).reshape(width, n).T for a in (y, fresh))
    fresh = fresh.copy()
    fresh[0] = 1
    y = np.ascontiguousarray(y)
    net.train(y, y, fresh, epochs, rate, last)


def fit(sample: list[str], total: np.ndarray, count: dict[bytes, int]) -> Model:
    """The model trained on texts at hand, from the statistics of all training words and the words' counts."""
    model = untrained(total, count)
    words, codes, sizes = split(pa.array(sample, pa.string()))
    if model.network is not None and len(codes):
        names = words.cast(pa.binary()).to_pylist()
        each = np.array([count.get(w, 0) for w in names], dtype=np.int64)
        code = np.array([model.code(w, c) for w, c in zip(names, each.tolist(), strict=True)], dtype=np.int64)
        learn(model.network, own(model, code, each)[codes], sizes)
        model.trained = len(codes)
    return model


#: Rows of codes: whole documents of PIECE_TOKENS or more (or all of a block) that train the network (chosen) or don't, and
#: what their counts give: known words, base score, the log10 shares of tail words.
PIECES = "key long, tokens long, chosen boolean, ids array<{}>, train array<boolean>, sizes binary, known binary, base binary, tail binary, codes binary"


def pieces(model: Model, code: np.ndarray, count: np.ndarray, counts: np.ndarray, codes: np.ndarray, columns: dict) -> pa.Table:
    """Rows of PIECES of a block.  Words seen twice have codes of their own, as they train as rare ones and score as tail words."""
    top = len(model.top)
    kinds = (code + np.where((count == 2) & (code >= top) & (code < top + ENDINGS), 2 * ENDINGS, 0)).astype(np.uint16)
    starts = np.cumsum(counts) - counts
    each = {"known": (count > 0).astype(np.int64), "base": model.base(count.astype(np.float64)), "tail": model.tail_logs(code, count)}
    each = {k: np.add.reduceat(v[codes], starts) if len(counts) else v[:0] for k, v in each.items()}  # no document is without a token
    chosen = np.asarray(columns["chosen"].fill_null(False), dtype=bool)
    rows = []
    for kind in (False, True):
        mine = np.flatnonzero(chosen == kind)
        y, sizes = kinds[codes[np.repeat(chosen == kind, counts)]], counts[mine]
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            before = int(ends[a - 1]) if a else 0
            b = min(len(sizes), int(np.searchsorted(ends, before + PIECE_TOKENS)) + 1)
            some, at = np.ascontiguousarray(y[before : int(ends[b - 1])]), pa.array(mine[a:b])
            rows.append((xxhash.xxh3_64_intdigest(some.tobytes()) - (1 << 63), len(some), kind, columns["doc_id"].take(at), columns["train"].take(at), pack(sizes[a:b].astype(np.uint32)), *(pack(each[k][mine[a:b]]) for k in each), pack(some)))
            a = b
    names = ["key", "tokens", "chosen", "ids", "train", "sizes", *each, "codes"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(columns["doc_id"].type), pa.list_(pa.bool_()), *[pa.binary()] * 5]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array([x.to_pylist() for x in c] if pa.types.is_list(t) else c, t) for c, t in zip(cols, types, strict=True)], names=names)


def trained(net: Network, rows: DataFrame, tasks: int, rate: float, last: float) -> tuple[Network, int]:
    """One round: each task goes on from net over its rows; the average by tokens, and the tokens."""
    rows = rows.select("key", "sizes", "codes")
    shared = rows.sparkSession.sparkContext.broadcast(net)
    groups = math.isqrt(tasks - 1) + 1
    shape = [(k, v.shape) for k, v in net.p.items()]

    def row(group: int, n: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["group", "tokens", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r["key"], r["sizes"], r["codes"]) for b in batches for r in b.to_pylist())
        if held:
            mine = copy.deepcopy(shared.value)
            y = np.concatenate([unpack(c, np.uint16) for _, _, c in held]).astype(np.int64)
            y[y >= mine.n_codes] -= ENDINGS  # words seen twice
            learn(mine, y, np.concatenate([unpack(z, np.uint32) for _, z, _ in held]).astype(np.int64), 1, rate, last)
            yield row(held[0][0] % groups, len(y), np.concatenate([mine.p[k].ravel() for k, _ in shape]).astype(np.float64) * len(y))
            release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0.0
        for b in batches:
            for k, x in zip(b.column("tokens").to_pylist(), b.column("sums"), strict=True):
                n, sums = n + k, sums + np.frombuffer(x.as_buffer(), np.float64)
        if n:
            yield row(0, n, sums)

    kind = "group int, tokens long, sums binary"
    each = rows.repartition(tasks, "key").mapInArrow(run, kind)
    if groups > 1:
        each = each.repartition(groups, "group").mapInArrow(add, kind)
    n, sums = 0, 0.0
    for r in each.toLocalIterator():  # at most the root of the number of tasks, each of the network's size
        n, sums = n + r["tokens"], sums + np.frombuffer(r["sums"], np.float64)
    out, at = copy.deepcopy(net), 0
    for k, s in shape:
        size = math.prod(s)
        out.p[k] = (sums[at : at + size] / n).astype(np.float32).reshape(s)
        at += size
    return out, n


def train_all(model: Model, rows: DataFrame) -> None:
    """Train the model's network on all these rows of PIECES, each in one of the rounds."""
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    if not tokens:
        return
    tasks = -(-tokens // TASK_TOKENS)
    net = model.network
    if tasks > 1:
        first = rows.where(F.pmod("key", F.lit(tasks)) == 0)  # one task's codes: networks from it can be averaged
        if not first.isEmpty():
            net, _ = trained(net, first, 1, RATE, RATE / 2)
    rounds = min(ROUNDS, tasks)
    for i in range(rounds):
        own = rows.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == i)
        if not own.isEmpty():
            net, n = trained(net, own, -(-tasks // rounds), RATE * (1 - i / rounds), RATE * (1 - (i + 1) / rounds))
            model.trained += n
    model.network = net


def log10_text(model: Model, docs: list[np.ndarray], count: list[np.ndarray], streams: int = 256, window: int = 64) -> np.ndarray:
    """Sum of log10 probabilities of each document's codes; the state goes through whole documents."""
    tail = np.array([model.tail_logs(d, c).sum() for d, c in zip(docs, count, strict=True)])
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    return tail + log10_codes(model.network, np.concatenate([np.zeros(0, np.int64), *docs]), sizes, streams, window) if model.network else np.zeros(len(docs))


def log10_codes(net: Network, codes: np.ndarray, sizes: np.ndarray, streams: int = 256, window: int = 64) -> np.ndarray:
    """Sum of log10 probabilities of the codes of each of the documents of these sizes, which follow each other.

    Documents go one after another through streams of about equal length, so that steps have full rows.
    """
    keep_pages()
    out, first = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
    lanes = [(0, j, []) for j in range(min(streams, len(sizes)))]
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, j, mine = lanes[0]
        if sizes[i]:
            mine.append(i)
            heapq.heapreplace(lanes, (n + int(sizes[i]), j, mine))
    lanes.sort(key=lambda x: (-x[0], x[1]))
    order = np.array([i for _, _, mine in lanes for i in mine], dtype=np.int64)
    if not len(order):
        return out
    long = np.array([n for n, _, _ in lanes if n], dtype=np.int64)
    start = np.cumsum(long) - long
    x = codes[ranges(first[order], sizes[order])]
    begin = np.cumsum(sizes[order]) - sizes[order]
    fresh = np.zeros(len(x), np.float32)
    fresh[begin] = 1
    got, gx, h = np.empty(len(x)), net.inputs(), np.zeros((len(long), HIDDEN), np.float32)
    for lo in range(0, int(long[0]), window):
        live = int((long > lo).sum())
        at = start[:live] + np.arange(lo, min(lo + window, int(long[0])))[:, None]
        use = at < (start + long)[:live]
        at[~use] = 0
        s = net.states(x[at], h[:live], fresh[at], gx=gx)
        h = net.last
        at = at[use]
        got[at] = net.logs(s[use], x[at])
    out[order] = np.add.reduceat(got, begin) / math.log(10)
    return out


def score(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text", seen: list | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; seen takes the model."""
    spark = docs.sparkSession
    d = id_and_text(docs, id_col, text_col).withColumn("train", train_rows("doc_id", modulus) != 0)
    buckets = blocks.bucket_count(docs)
    d = d.withColumn("chosen", F.col("train") & (F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0))
    dicts, places = blocks.once(d, split, buckets, "train", dealt)
    table = materialize(counted(dicts, buckets), "word-counts")
    total, count = np.zeros(4 + ENDINGS, dtype=np.int64), {}
    for r in table.where("block is null").toLocalIterator():  # a row a task, of at most TOP words
        got = unpack(r["counts"], np.int64)
        total += got[: 4 + ENDINGS]
        count.update(zip(blocks.unpack_words(r["lens"], r["words"]), got[4 + ENDINGS :].tolist(), strict=True))
        if len(count) > 16 * TOP:
            count = {w: count[w] for w in frequent(count)}
    model = untrained(total, count)
    del count
    words = spark.sparkContext.broadcast(model)
    found = table.where("block is not null")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [unpack(x, np.uint32) for x in b.column("counts").to_pylist()]
            found, each = blocks.joined_words(b.column("lens").to_pylist(), b.column("words").to_pylist())
            code = words.value.codes(found, np.concatenate([np.zeros(0, np.uint32), *c])).astype(np.uint16)
            ends = np.cumsum(each)
            lens, vals = [pack(code[lo:hi]) for lo, hi in zip(ends - each, ends, strict=True)], [pack(x) for x in c]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("start"), b.column("n"), pa.array(lens, pa.binary()), pa.array(vals, pa.binary())], names=["block", "start", "n", "lens", "vals"])

    def coded_rows(lens: bytes, vals: bytes, counts: np.ndarray, codes: np.ndarray, columns: dict) -> pa.Table:
        return pieces(words.value, np.frombuffer(lens, np.uint16).astype(np.int64), np.frombuffer(vals, np.uint32), counts, codes, columns)

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = materialize(blocks.reassemble(found.mapInArrow(values, blocks.VALUES), d, split, buckets, coded_rows, PIECES.format(kind), places), "codes")
    train_all(model, rows.where("chosen"))
    if seen is not None:
        seen.append(model)
    shared = spark.sparkContext.broadcast(model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                held.append(b.slice(i, 1))
                n += b.column("tokens")[i].as_py()
                if n >= TASK_TOKENS:
                    yield scored(shared.value, held)
                    held, n = [], 0
        if held:
            yield scored(shared.value, held)
        release()

    return rows.mapInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(model: Model, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The result's rows of the documents of some rows of PIECES."""
    t = pa.Table.from_batches(held)
    sizes, known, base, tail, codes = (np.concatenate([unpack(x, kind) for x in t.column(k).to_pylist()]) for k, kind in (("sizes", np.uint32), ("known", np.int64), ("base", np.float64), ("tail", np.float64), ("codes", np.uint16)))
    ids, train = (pa.concat_arrays([c.flatten() for c in t.column(k).chunks]) for k in ("ids", "train"))
    sizes, codes = sizes.astype(np.int64), codes.astype(np.int64)
    got = np.zeros(len(sizes))
    if model.network is not None:
        codes[codes >= model.network.n_codes] -= 2 * ENDINGS  # words seen twice
        got = tail + log10_codes(model.network, codes, sizes)
    cols = {"doc_id": ids, "held_out": pc.invert(train), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(sizes), model.n, np.int64)), "base_score": pa.array(base), "score": pa.array(got)}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
