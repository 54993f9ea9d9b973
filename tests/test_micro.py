"""Hand-made rows: edges that the driver's tables don't have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import text as T
from meridian.functions import vec as V
from meridian.operators import lexical as L
from meridian.operators import scan as C
from meridian.operators import shift as S
from meridian.operators import stats as St
from meridian.operators import training
from meridian.operators.knn import knn
from meridian.sources import readers as R
from meridian.streaming import scan as SS


def one(df):
    return df.first()[0]


def test_vector_edges(spark):
    d = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "z array<double>, v array<double>")
    assert one(V.normalised(d, "n", "z").select("n")) == [0.0, 0.0]
    assert one(V.normalised(d, "n", "v").select("n")) == [0.6, 0.8]
    assert one(V.truncated(d, "n", "v", 2).select(F.round(V.norm("n"), 9))) == 1.0
    assert one(d.select(V.poincare("z", "z"))) == 0.0
    assert one(d.select(F.size(V.clamped("v")))) == 2 and one(d.select(V.norm(V.clamped("v")))) < 1


def test_geodesic_ends(spark):
    d = spark.createDataFrame([([0.1, 0.2], [-0.5, 0.3])], "u array<double>, v array<double>")
    g = V.geodesic(d, "p", "u", "v").orderBy("step").collect()
    assert len(g) == 64 and np.allclose(g[0].p, [0.1, 0.2]) and np.allclose(g[-1].p, [-0.5, 0.3])


def test_shift_identity_and_missing_language(spark):
    rows = [(0, 1, "en", [1.0, 0.0]), (1, 1, "de", [0.0, 1.0]), (2, 2, "fr", [0.6, 0.8])]
    d = spark.createDataFrame(rows, "id long, concept int, lang string, vec array<double>")
    o = S.offsets(d, "en")
    assert [r.lang for r in o.collect()] == ["de"]  # fr has no pair
    same = {r.id: r.vec for r in S.apply(d, o, 0.0).collect()}
    assert same == {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [0.6, 0.8]}
    moved = {r.id: r.vec for r in S.apply(d, o, 1.0).collect()}
    assert np.allclose(moved[1], [1.0, 0.0]) and moved[2] == [0.6, 0.8]


def test_knn_ties_blocks_and_empty(spark):
    d = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, vec array<double>")
    a = sorted((r.query_id, r.rank, r.doc_id) for r in knn(d, d, 2).collect())
    b = sorted((r.query_id, r.rank, r.doc_id) for r in knn(d, d, 2, broadcast=False).collect())
    assert a == b and a[0] == (0, 1, 1) and a[1] == (0, 2, 2) and len(a) == 10
    assert knn(d.limit(1), d.limit(1), 3).count() == 0  # only itself
    assert knn(d.limit(0), d, 3).count() == 0


def test_names(spark):
    d = spark.createDataFrame([("HERCEPTIN 150 mg POLVO",), ("5 alfa",), ("-abc def",), ("VFEND",), ("",), (None,)], "b string")
    heads = [r[0] for r in d.select(T.brand_head("b")).collect()]
    assert heads == [["herceptin"], [], [], ["vfend"], [], []]
    short = [r[0] for r in d.select(T.brand_short("b")).collect()]
    assert short == ["HERCEPTIN", "5 alfa", "-abc def", "VFEND", "", ""]
    s = spark.createDataFrame([("LIDOCAINEHYDROCHLORIDE 1-WATER# #ZINK#A B#D",)], "r string")
    assert one(s.select(T.clean_substance("r"))) == "Lidocainehydrochloride, Zink, A b"


def test_language_id_unknown(spark):
    docs = spark.createDataFrame([("en", "the house"), ("de", "das haus")], "lang string, text string")
    q = spark.createDataFrame([(1, "the house"), (2, "xyz"), (3, "")], "id long, text string")
    r = {x.id: x for x in L.identify(q, *L.document_frequency(docs)).collect()}
    assert r[1].lang == "en" and r[1].confident and r[2].lang is None and not r[2].confident and r[3].coverage == 0


def test_rrf_order_free(spark):
    h = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank int")
    g = spark.createDataFrame([(1, 6, 1)], "query_id long, doc_id long, rank int")
    a, b = ([(r.doc_id, r.rank) for r in L.rrf(*x).orderBy("rank").collect()] for x in ((h, g), (g, h)))
    assert a == b == [(6, 1), (5, 2)]


def test_identify_product(spark):
    blocks = spark.createDataFrame([(1, 0, 1, "Vfend", 0.9, 0.01), (1, 0, 2, "polvo grande", 0.9, 0.5)], "scan_id long, frame int, pos int, text string, confidence double, area double")
    hits = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.9, 2)], "query_id long, doc_id long, score double, rank int")
    names = spark.createDataFrame([(7, "VFEND 50 mg"), (8, "VFEND 200 mg")], "doc_id long, brand string")
    r = C.identify(blocks, hits, names).first()
    assert (r.short, r.text, r.located_by, r.runner_up, r.confident, r.p) == ("VFEND", "Vfend", "name", "VFEND 200 mg", False, 0.5)


def test_rank_methods(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id long, a double")
    assert sorted((r.id, r.r_a) for r in St.ranked(d, ["a"], "id").collect()) == [(1, 2.0), (2, 3.0), (3, 1.0)]
    assert sorted((r.id, r.r_a) for r in St.ranked(d, ["a"], "id", "average").collect()) == [(1, 2.5), (2, 2.5), (3, 1.0)]


def test_training_stays_in_ball():
    e = training.train(np.array([[1, 0], [2, 0], [3, 1], [4, 1]]), 5, 2, "poincare", epochs=30, negatives=4)
    assert np.isfinite(e).all() and (np.linalg.norm(e, axis=1) < 1).all()


def test_readers(spark, tmp_path):
    row = lambda name, atc, holder="h": ";".join(["1", name, "inn"] + ["x"] * 4 + ["10 mg", "tab"] + ["x"] * 3 + [atc, holder, "a", "b"])
    (tmp_path / "pl.csv").write_text("﻿Id;" + ";".join("abcdefghijklmno") + "\n" + "\n".join([row("Foo", "A01AB01"), row("FOO", "A01AB01"), row("Vet", "QA01AB1"), row("Short", "A01"), "1;2;3"]) + "\n", encoding="utf-8")
    assert [(r.brand, r.atc) for r in R.registry_positional(spark, str(tmp_path / "pl.csv")).collect()] == [("Foo", "A01AB01")]
    (tmp_path / "nl.csv").write_text("ATC|PRODUCTNAAM|WERKZAMESTOFFEN|FARMACEUTISCHEVORM|POTENTIE|HANDELSVERGUNNINGHOUDER|REGISTRATIENUMMER\nC01AA05 - Digoxin|Lanoxin|DIGOXINE 1-WATER|tab|1|h|9\n|x|y|z|1|h|8\n")
    r = R.registry_named(spark, str(tmp_path / "nl.csv")).collect()
    assert [(x.atc, x.inn, x.rvg) for x in r] == [("C01AA05", "Digoxine", "9")]
    assert R.registry_named(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "es.json").write_text('{"nombre":"A","atc":"C01AA05","nregistro":"1"}\n{"nombre":"B","atc":"C01AA05","vtm":{"nombre":"digoxina"},"fotos":[{"tipo":"materialas","url":"u"}]}\n')
    e = {x.brand: x for x in R.registry_json(spark, str(tmp_path / "es.json")).collect()}
    assert e["A"].inn == "" and e["A"].photos == [] and e["B"].inn == "digoxina" and e["B"].photos[0].url == "u"
    (tmp_path / "tax.txt").write_text("# head\n\n1 - A\n2 - A > B - C\n")
    t = {x.id: x for x in R.taxonomy_text(spark, str(tmp_path / "tax.txt")).collect()}
    assert t[2].parts == ["A", "B - C"] and t[2].depth == 1 and len(t) == 2
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [list(x.vec) for x in R.npy_vectors(spark, str(tmp_path / "v.npy")).orderBy("id").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "idx.json").write_text('{"resultados":[{"codigo":"A","nombre":"n"}],"tamanioPagina":200}')
    assert R.code_index(spark, str(tmp_path / "idx.json")).first().name == "n"
    with pytest.raises(ValueError):
        R.named_vector(spark.createDataFrame([(((1.0,), (2.0,)),)], "v struct<a:struct<x:double>,b:struct<x:double>>"), "v")


def test_parallel_intersection(spark):
    f = {k: spark.createDataFrame(v, "id long, name string, full_path string") for k, v in {"en": [(1, "a", "a"), (2, "b", "b")], "de": [(2, "c", "c")]}.items()}
    assert sorted((r.lang, r.id) for r in R.parallel(f).collect()) == [("de", 2), ("en", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, 1, "Foo", 0.9, 0.1), (1, 1, 1, "foo ", 0.9, 0.1), (1, 1, 2, "bar", 0.2, 0.9)]
    b = spark.createDataFrame(rows, "scan_id long, frame int, pos int, text string, confidence double, area double")
    b.write.parquet(str(tmp_path / "b"))
    s = SS.drained(SS.best_readings(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b"))), "complete", "t_readings")
    assert sorted(s.collect()) == sorted(C.best_readings(b).collect()) and s.count() == 1
