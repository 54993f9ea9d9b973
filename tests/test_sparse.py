"""BM25 in the streamed kernel against brute force: frequent and rare terms, copies, texts without words."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from meridian.operators import knn as K
from meridian.operators import lexical as L
from meridian.operators import sparse as P
from meridian.plans import registry


@pytest.mark.parametrize("one_in", [1, 3, 10_000])
def test_bm25_lists(spark, monkeypatch, one_in):
    monkeypatch.setattr(P, "ONE_IN", one_in)  # no matrix columns, some, all terms
    monkeypatch.setattr(P, "QUERIES", 20)
    monkeypatch.setattr(P, "DOCS", 16)
    monkeypatch.setattr(K, "BLOCK", 30)
    rng = random.Random(1)
    texts = {i: " ".join(f"{rng.choice('abc')}{'xyz'[rng.randrange(3)]}{chr(97 + min(int(rng.expovariate(0.3)), 25))}" for _ in range(rng.randrange(1, 30))) for i in range(150)}
    texts |= {150: texts[3], 151: texts[3], 152: "", 153: None, 154: "alone here"}
    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    got = collections.defaultdict(dict)
    for r in P.bm25(d, L.words("text"), 5, F.col("id") % 2 == 1, F.col("id") % 3 < 2).collect():
        got[r.query_id][r["rank"]] = (r.doc_id, r.score)
    c = {i: collections.Counter((t or "").split()) for i, t in texts.items()}
    docs = [i for i in c if i % 3 < 2]
    df, mean = collections.Counter(t for i in docs for t in c[i]), sum(sum(c[i].values()) for i in docs) / len(docs)
    for q in (i for i in c if i % 2 == 1):
        s = {}
        for i in docs:
            if i != q and c[q].keys() & c[i].keys():
                s[i] = round(sum(f * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[i][t] * 2.2 / (c[i][t] + 1.2 * (0.25 + 0.75 * sum(c[i].values()) / mean)) for t, f in c[q].items() if t in c[i]), 7)
        want = sorted(s, key=lambda i: (-s[i], i))[:5]
        assert [got[q][k][0] for k in range(1, len(want) + 1)] == want and len(got[q]) == len(want)
        assert [got[q][k][1] for k in range(1, len(want) + 1)] == pytest.approx([s[i] for i in want], abs=2e-7)


@pytest.mark.parametrize("name", ["bm25_corpus", "rrf_corpus", "method_compare_corpus", "configurations_lexical", "sparse_dot", "sparse_dot_all"])
def test_no_rows_of_pairs(spark, name):
    """Pairs meet in a kernel: the plan has no join of terms with terms and no sum over pairs."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "sum((qw" not in plan


def test_blocks_fill_waves_of_tasks():
    blocks = lambda n: -(-n // P.even(n, P.BLOCK_ROWS, 6))
    assert blocks(102_564) == 6  # seven before, the seventh alone in a wave of its own
    assert [blocks(n) for n in (0, 1, 60_000, 6 * P.BLOCK_ROWS)] == [0, 1, 4, 6]
    assert all(P.even(n, P.BLOCK_ROWS, 6) <= P.BLOCK_ROWS * 5 // 4 for n in range(1, 2_000_000, 9_973))
