"""Queries without SQL over whole tables, against brute force."""

import collections
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from meridian.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus():
    """id: (lang, term counts), of documents that have a vector."""
    e = set(pq.read_table(f"{SF}/embeddings.parquet")["vec_id"].to_pylist())
    d = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: (r["lang"], collections.Counter(re.findall(r"[^\W\d_]{3,}", r["text"].lower()))) for r in d if r["doc_id"] in e}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_bm25_over_documents(spark, corpus):
    df = collections.Counter(t for _, c in corpus.values() for t in c)
    n, mean = len(corpus), sum(sum(c.values()) for _, c in corpus.values()) / len(corpus)
    w = {i: {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, f in c.items()} for i, (_, c) in corpus.items()}
    got = collections.defaultdict(dict)
    for r in run(spark, "bm25_corpus"):
        got[r.query_id][r.rank] = r.score
    for q, (_, c) in corpus.items():
        s = sorted((sum(f * w[i].get(t, 0.0) for t, f in c.items()) for i in corpus if i != q and c.keys() & w[i].keys()), reverse=True)[:10]
        assert [got[q][k] for k in sorted(got[q])] == pytest.approx(s, abs=2e-4), q


def test_matched_terms_of_the_target_language(spark, corpus):
    target = {t for lang, c in corpus.values() if lang == "en" for t in c}
    got = {r.query_id: (r.terms, r.matched) for r in run(spark, "matched_terms_target")}
    assert got == {i: (len(c), len(c.keys() & target)) for i, (_, c) in corpus.items() if c}


def test_fusion_over_documents(spark, corpus):
    assert {r.query_id for r in run(spark, "rrf_corpus")} == set(corpus)
    got = collections.Counter((r.method, r.query_id) for r in run(spark, "method_compare_corpus"))
    assert all(got["dense", i] == got["rrf", i] == 3 for i in corpus) and {m for m, _ in got} == {"dense", "bm25", "rrf", "sparse"}


@pytest.fixture(scope="module")
def vectors():
    e = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    return np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], dtype=np.float64), {r["vec_id"]: r["label"] for r in e}


def test_maxsim_whatever_the_label(spark, vectors):
    ids, v, label = vectors
    at = {k: i for i, k in enumerate(ids.tolist())}
    got = run(spark, "maxsim_prefetch")
    assert len(got) == 5 * len(ids) and any(label[r.query_id] != label[r.doc_id] for r in got)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.score, r.minmax)
    cos = np.round(v @ v.T, 9)
    np.fill_diagonal(cos, -np.inf)
    for q in ids.tolist():
        near = np.lexsort((ids, -cos[at[q]]))[:50]
        x, y = v[at[q]].reshape(8, 8), v[near].reshape(50, 8, 8)
        s = np.sort(np.einsum("ak,nbk->nab", x, y).max(2).sum(1))[::-1]
        assert [by[q][k][0] for k in range(1, 6)] == pytest.approx(s[:5], abs=1e-4)
        assert [by[q][k][1] for k in range(1, 6)] == pytest.approx((s[:5] - s[-1]) / (s[0] - s[-1]), abs=1e-4)


def test_sparse_dot_whatever_the_concept(spark, vectors, corpus):
    ids, v, label = vectors
    keep = [i for i, k in enumerate(ids.tolist()) if k in corpus]
    p = np.maximum(v[keep], 0)
    s = p @ p.T
    np.fill_diagonal(s, 0)
    got = collections.defaultdict(list)
    for r in sorted(run(spark, "sparse_dot_all"), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, label[r.doc_id] != label[r.query_id]))
    for i, q in enumerate(ids[keep].tolist()):
        best = np.sort(s[i][s[i] > 0])[::-1][:3]
        assert [x for x, _ in got[q]] == pytest.approx(best, abs=1e-4)
    assert any(other for x in got.values() for _, other in x)


def test_lexical_configurations(spark, vectors, corpus):
    """Top 1, 3, 10 of every list into the pivot language, from ranks worked out here."""
    ids, v, label = vectors
    at = {k: i for i, k in enumerate(ids.tolist())}
    target = [i for i, (lang, _) in corpus.items() if lang == "en"]
    df = collections.Counter(t for i in target for t in corpus[i][1])
    mean = sum(sum(corpus[i][1].values()) for i in target) / len(target)
    w = {i: {t: math.log(1 + (len(target) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(corpus[i][1].values()) / mean)) for t, f in corpus[i][1].items()} for i in target}
    firsts = collections.defaultdict(list)
    for q in (i for i, (lang, _) in corpus.items() if lang != "en"):
        scores = {
            "dense": {i: round(float(v[at[q]] @ v[at[i]]), 9) for i in target},
            "bm25": {i: round(sum(f * w[i].get(t, 0.0) for t, f in corpus[q][1].items()), 7) for i in target if corpus[q][1].keys() & w[i].keys()},
            "sparse": {i: round(float(np.maximum(v[at[q]], 0) @ np.maximum(v[at[i]], 0)), 7) for i in target},
        }
        order = {k: sorted((i for i in x if k != "sparse" or x[i] > 0), key=lambda i: (-x[i], i))[:100] for k, x in scores.items()}
        both = collections.Counter()
        for k in ("dense", "bm25"):
            for r, i in enumerate(order[k], 1):
                both[i] += 1 / (60 + r)
        order["rrf"] = sorted(both, key=lambda i: (-round(both[i], 12), i))[:100]
        for k, x in order.items():
            firsts[k].append(next((r for r, i in enumerate(x, 1) if label[i] == label[q]), 101))
    got = {r.config: r for r in run(spark, "configurations_lexical")}
    assert got.keys() == firsts.keys()
    for k, x in firsts.items():
        assert got[k].n == len(x)
        assert (got[k].top1, got[k].top3, got[k].top10, got[k].ceiling) == pytest.approx([np.mean(np.array(x) <= n) for n in (1, 3, 10, 100)], abs=2 / len(x) + 1e-4)


def test_endpoints(spark):
    """Each endpoint is a selection of what the registered query gives."""
    from meridian.plans import endpoints as E

    code = run(spark, "tree_geometry")[-1].code
    disk = E.disk(spark, SF, code)
    assert disk["points"].count() > 0 and disk["chain"].count() >= 1 and {r.code for r in disk["path"].collect()} <= {code}
    some = run(spark, "knn_cosine")[0].query_id
    want = sorted((r["rank"], r.doc_id) for r in run(spark, "knn_cosine") if r.query_id == some)
    assert sorted((r["rank"], r.doc_id) for r in E.search(spark, SF, some).collect()) == want
    assert {r.lang for r in E.search(spark, SF, some, 5, "en").collect()} == {"en"}
    assert {r.panel for r in E.panels(spark, SF, some).collect()} == {"hyperbolic", "euclidean", "text"}
    assert E.compare(spark, SF, some).count() == 2 and E.methods(spark, SF, some).count() >= 9 and E.ancestors(spark, SF, 1).count() == 1
    assert all(x(spark, SF).count() > 0 for x in (E.anomalies, E.tree, E.demo_queries, E.language))


def test_knn_by_any_blocking(spark):
    """Ties, long lists, and several batches against a full sort."""
    from pyspark.sql import functions as F

    from meridian.operators.knn import knn, scores

    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (400, 8)) / 4.0  # many ties
    ids = rng.permutation(400) + 1
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, vec array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for metric in ("cosine", "euclid", "angular", "maxsim:4", "-maxsim:4"):
            s = np.round(scores(metric, v, v), 9) + 0.0
            for k, broadcast in ((7, True), (7, False), (2000, True)):
                got = collections.defaultdict(dict)
                for r in knn(d, d, k, metric, broadcast=broadcast).where(F.col("query_id") <= 40).collect():
                    got[r.query_id][r["rank"]] = r.doc_id
                for q in range(400):
                    if ids[q] <= 40:
                        order = sorted((j for j in range(400) if j != q), key=lambda j: (-s[q, j], ids[j]))[:k]
                        assert [got[ids[q]][r] for r in sorted(got[ids[q]])] == [ids[j] for j in order], (metric, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_sweep_of_lengths_is_one_plan(spark):
    from meridian.operators import shift
    from meridian.plans import retrieval
    from meridian.sources import fixtures

    c = fixtures.vectors(spark, SF)
    parts = retrieval._cut_and_shifted(c, shift.offsets(c, fixtures.PIVOT))
    plan = retrieval.matryoshka_sweep(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # the two inputs of the lists, and the judging of hits: a scan for each of eight parts and sides would be over 100
    assert plan.count("Relation [") < 20 and plan.count("MapInArrow") == 1
    assert {tuple(r) for r in parts.groupBy("part").count().collect()} == {(f"{o}{n}", c.count()) for o in ("shift_first", "truncate_first") for n in (64, 32, 16, 8)}
