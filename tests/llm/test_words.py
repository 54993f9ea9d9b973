"""Words handled all at once: numbers to deal them by, codes, counts."""

import zlib

import numpy as np
import pyarrow as pa

from meridian.llm import blocks, gru_lm
from meridian.llm.common import dealt, unpack

WORDS = [b"", b"a", b"ab", b"ba", b"\xc3\xa4", b"the", b"eth", b"x" * 5_000, b"\x00", b"\x00\x00", b"\n"]


def test_numbers_of_words():
    """A word's number doesn't depend on where it stands; different words differ and are spread evenly."""
    n = dealt(pa.array(WORDS, pa.binary()))
    assert len(set(n.tolist())) == len(WORDS)
    back = dealt(pa.array(WORDS[::-1], pa.large_binary()).slice(2, 5))
    assert back.tolist() == n[::-1][2:7].tolist()
    assert len(dealt(pa.array([], pa.string()))) == 0
    many = np.bincount((dealt(pa.array([f"w{i}" for i in range(20_000)])) % np.uint64(20)).astype(int), minlength=20)
    assert 850 < many.min() <= many.max() < 1_150


def test_codes_of_words():
    model = gru_lm.Model(100, 9, 2, 2, np.ones(gru_lm.ENDINGS), {b"the": 0, b"ab": 1}, None)
    count = np.arange(len(WORDS)) % 4
    assert gru_lm.endings(pa.array(WORDS, pa.large_binary())).tolist() == [gru_lm.ending(w) for w in WORDS]
    assert gru_lm.endings(pa.array([], pa.binary())).tolist() == []
    assert model.codes(pa.array(WORDS, pa.large_binary()), count).tolist() == [model.code(w, c) for w, c in zip(WORDS, count.tolist())]


def test_one_reading_gives_both_tables(spark, monkeypatch):
    """The documents are split once, and word counts and statistics are those of the training texts."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(gru_lm, "TOP", 5)

    def split(text):
        seen.add(len(text))
        return gru_lm.split(text)

    rows = [(i, f"w{i % 7} pair{i // 2} once{i} the the", zlib.crc32(str(i).encode()) % 10 > 0) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    words, places = blocks.once(d, split, 3, "train", dealt)
    table = gru_lm.counted(words, 3).collect()
    assert seen.value == 60 and sum(len(r.doc_id) for r in places.collect()) == 60
    want: dict = {}
    for _, t, train in rows:
        for w in [*t.split(), "\n"]:
            want[w.encode()] = want.get(w.encode(), 0) + train
    for r in table:
        if r.block is not None:
            assert unpack(r.counts, np.uint32).tolist() == [want[w] for w in blocks.unpack_words(r.lens, r.words)]
    stats = [r for r in table if r.block is None]
    sums = sum(unpack(r.counts, np.int64)[: 4 + gru_lm.ENDINGS] for r in stats)
    c = list(want.values())
    assert sums[:4].tolist() == [sum(c), sum(x > 0 for x in c), c.count(1), c.count(2)]
    assert sums[4:].tolist() == [sum(x for w, x in want.items() if x >= 2 and gru_lm.ending(w) == e) for e in range(gru_lm.ENDINGS)]
    most = {w: x for r in stats for w, x in zip(blocks.unpack_words(r.lens, r.words), unpack(r.counts, np.int64)[4 + gru_lm.ENDINGS :].tolist())}
    assert gru_lm.frequent(most) == gru_lm.frequent(want) and all(want[w] == x for w, x in most.items())
