"""The recurrent network learns from every training document, as the module is shipped."""

import zlib

import numpy as np
import pytest

from meridian.llm import gru_lm


def test_network_sees_all_training_tokens(spark):
    rows = [(i, f"w{i % 7} and so on") for i in range(300)]
    seen: list = []
    assert gru_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), seen=seen).count() == 300
    assert seen[0].trained == seen[0].n == sum(5 for i, _ in rows if zlib.crc32(str(i).encode()) % 10)


def test_each_document_is_read_for_its_positions_once(spark, monkeypatch):
    """Training and scoring share one table of codes, which keeps words seen twice apart."""
    calls = []
    monkeypatch.setattr(gru_lm.blocks, "positions", lambda *a, f=gru_lm.blocks.positions: calls.append(1) or f(*a))
    rows = [(i, f"w{i % 7} pair{i // 2} once{i}") for i in range(60)]
    got = {r.doc_id: r for r in gru_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(calls) == 1 and len(got) == 60
    train = [i for i in got if zlib.crc32(str(i).encode()) % 10]
    known = {w for i in train for w in [*rows[i][1].split(), "\n"]}
    assert all(got[i].n_known == sum(w in known for w in [*rows[i][1].split(), "\n"]) for i in got)


def test_streams_hold_whole_documents():
    """A document's score doesn't depend on what goes before it in its stream."""
    net = gru_lm.Network([1, 3, 2, 5])
    rng = np.random.default_rng(3)
    sizes = np.array([7, 90, 1, 33, 0, 12, 200, 5])
    codes = rng.integers(0, net.n_codes, sizes.sum())
    ends = np.cumsum(sizes)
    alone = [gru_lm.log10_codes(net, codes[e - n : e], np.array([n]))[0] for e, n in zip(ends, sizes)]
    for streams in (1, 3, 256):
        assert gru_lm.log10_codes(net, codes, sizes, streams, 16) == pytest.approx(alone, rel=1e-4)
