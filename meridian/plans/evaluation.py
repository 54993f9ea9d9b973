"""Evaluations over shared candidate lists, metric invariance, ancestor chains and sibling profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..operators import metrics as M
from ..operators import shift as S
from ..operators.knn import knn
from ..sources import fixtures as X
from .geometry import GEO, NODES, RAD, TREE_BALL, ZED, _mob, _nodes, _robust
from .lexical import ALL, TOKENS
from .oracle import BALL, CORPUS, DOT, SQD, TAX, ctes, knn as oknn, offs, poincare, query, shifted
from .retrieval import CODES, DIST, J, _codes

r4 = M.r4
PREFETCH = 50
BETA, SCALE = 0.08, 13.0

TOKEN_MAX = "greatest(" + ", ".join(f"list_inner_product(qt, d.vec[{8 * g + 1}:{8 * g + 8}])" for g in range(8)) + ")"
LATE = "list_sum([" + ", ".join(TOKEN_MAX.replace("qt", f"q.vec[{8 * g + 1}:{8 * g + 8}]") for g in range(8)) + "])"


@query(
    ctes(BALL, CODES, DIST, CORPUS, "qs as (select *, '' part from corpus where lang <> 'en')", "ds as (select *, '' part from corpus where lang = 'en')", oknn("pf", "qs", "ds", PREFETCH),
         f"c0 as (select pf.query_id, pf.doc_id, pf.\"rank\" prior, pf.score cos, round({LATE}, 9) late, coalesce({BETA} * dd / {SCALE}::double, 0) h, (q.concept = d.concept)::int hit from pf join corpus q on q.id = pf.query_id join corpus d on d.id = pf.doc_id left join dist on dist.a = q.concept and dist.b = d.concept)",
         "c1 as (select *, (late - min(late) over w) / greatest(max(late) over w - min(late) over w, 1e-9) form from c0 window w as (partition by query_id))",
         "c2 as (select query_id, prior, hit, unnest(['dense', 'dense+hyp', 'late', 'late+hyp']) config, unnest([cos, cos - h, form, form - h]) s from c1)",
         "c3 as (select *, row_number() over (partition by config, query_id order by round(s, 9) desc, prior) r from c2)",
         "c4 as (select config, query_id, max(hit) ceiling, max((hit = 1 and r <= 1)::int) t1, max((hit = 1 and r <= 3)::int) t3, max((hit = 1 and r <= 10)::int) t10 from c3 group by 1, 2)")
    + "select config, count(*) n, round(avg(t1), 4) top1, round(avg(t3), 4) top3, round(avg(t10), 4) top10, round(avg(ceiling), 4) prefetch_ceiling from c4 group by 1"
)
def configurations(spark, d):
    """Dense and late interaction, with and without the hyperbolic term, over one candidate list, and the list's ceiling.

    The anchor is the query's own concept, as if its own language had told it.
    """
    c = X.vectors(spark, d)
    v = c.select("id", "concept", "vec")
    pf = knn(c.where(F.col("lang") != X.PIVOT), c.where(F.col("lang") == X.PIVOT), PREFETCH).select("query_id", "doc_id", F.col("rank").alias("prior"), F.col("score").alias("cos"))
    j = pf.join(v.withColumnsRenamed({"id": "query_id", "concept": "a", "vec": "qv"}), "query_id").join(v.withColumnsRenamed({"id": "doc_id", "concept": "b", "vec": "dv"}), "doc_id")
    best = [F.greatest(*[V.dot(F.slice("qv", 8 * g + 1, 8), F.slice("dv", 8 * k + 1, 8)) for k in range(8)]) for g in range(8)]
    j = j.withColumn("late", F.round(sum(best[1:], best[0]), 9)).drop("qv", "dv").join(F.broadcast(_codes(spark, d)), ["a", "b"], "left")
    w = Window.partitionBy("query_id")
    j = j.withColumns({"form": (F.col("late") - F.min("late").over(w)) / F.greatest(F.max("late").over(w) - F.min("late").over(w), F.lit(1e-9)), "h": F.coalesce(BETA * F.col("dd") / SCALE, F.lit(0.0)), "hit": (F.col("a") == F.col("b")).cast("int")})
    scores = {"dense": F.col("cos"), "dense+hyp": F.col("cos") - F.col("h"), "late": F.col("form"), "late+hyp": F.col("form") - F.col("h")}
    each = j.select("query_id", "prior", "hit", F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.round(x, 9).alias("s")) for k, x in scores.items()])).alias("x")).select("query_id", "prior", "hit", "x.*")
    r = each.withColumn("r", F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.col("s").desc(), "prior")))
    per = r.groupBy("config", "query_id").agg(F.max("hit").alias("ceiling"), *[F.max(F.when(F.col("r") <= k, F.col("hit")).otherwise(0)).alias(f"t{k}") for k in (1, 3, 10)])
    return per.groupBy("config").agg(F.count("*").alias("n"), *[r4(F.avg(f"t{k}")).alias(f"top{k}") for k in (1, 3, 10)], r4(F.avg("ceiling")).alias("prefetch_ceiling"))


GEODESIC = (
    "gz as (select id, concept, lang, vec, off is null nooff, coalesce(off, list_transform(vec, lambda x: 0.0::double)) off from corpus left join offs using (lang)), g0 as (select *, list_inner_product(vec, off) vo from gz), "
    "g1 as (select *, list_transform(list_zip(off, vec), lambda p: -p[1] + vo * p[2]) t from g0), g2 as (select *, greatest(sqrt(list_inner_product(t, t)), 1e-12) tn from g1), "
    "g as (select id, concept, lang, case when nooff then vec else list_transform(list_zip(vec, t), lambda p: cos(0.75 * tn) * p[1] + sin(0.75 * tn) * p[2] / tn) end vec from g2)"
)


@query(
    ctes(CORPUS, offs(), shifted("f", [0.75]), GEODESIC, "qs as (select 'flat' part, id, vec from f where lang <> 'en' union all select 'geodesic', id, vec from g where lang <> 'en')",
         "ds as (select part, id, vec from corpus, (select unnest(['flat', 'geodesic']) part) where lang = 'en')", oknn("hits", "qs", "ds", 10), J,
         "b as (select part, q_lang, query_id, min(case when match then \"rank\" end) r from j group by 1, 2, 3)")
    + "select part operator, q_lang lang, count(*) n, round(avg((coalesce(r, 99) <= 1)::int), 4) hit_1, round(avg((coalesce(r, 99) <= 3)::int), 4) hit_3, round(avg((coalesce(r, 99) <= 10)::int), 4) hit_10 from b group by 1, 2"
)
def flat_vs_geodesic_hits(spark, d):
    """Hits on the pivot's shelf after the flat shift and after the one along the sphere, by language."""
    c = X.vectors(spark, d)
    o = S.offsets(c, X.PIVOT)
    flat = S.apply(c, o, 0.75).select("id", "lang", "vec", F.lit("flat").alias("part"))
    geo = V.geodesic_shift(c.join(F.broadcast(o), "lang", "left"), "g", "vec", "off", 0.75).select("id", "lang", F.coalesce("g", "vec").alias("vec"), F.lit("geodesic").alias("part"))
    shelf = c.where(F.col("lang") == X.PIVOT).select("id", "vec", F.explode(F.array(F.lit("flat"), F.lit("geodesic"))).alias("part"))
    j = M.judged(knn(flat.union(geo).where(F.col("lang") != X.PIVOT), shelf, 10), c.drop("vec"))
    per = j.groupBy("part", "q_lang", "query_id").agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("r"))
    hits = [r4(F.avg((F.coalesce("r", F.lit(99)) <= k).cast("double"))).alias(f"hit_{k}") for k in (1, 3, 10)]
    return per.groupBy(F.col("part").alias("operator"), F.col("q_lang").alias("lang")).agg(F.count("*").alias("n"), *hits)


CURVATURES = [0.25, 0.5, 1.0, 2.0, 4.0]
KS = [1, 3, 10]
_RAW = "1 + 2 * {s} / ((1 - list_inner_product(q.vec, q.vec)) * (1 - list_inner_product(d.vec, d.vec)))"


@query(
    ctes(CORPUS, f"sp as (select 'cosine' part, 1.0::double k union all select 'euclidean', 1.0 union all select 'angular', 1.0 union all select 'poincare c=' || c, tanh(sqrt(c)) / sqrt(c) from (select unnest({CURVATURES})::double c))",
         "v as (select part, id, lang, list_transform(vec, lambda x: x * k) vec from corpus, sp)",
         f"s as (select q.part, q.id query_id, d.id doc_id, round(case when q.part = 'cosine' then {DOT} when q.part = 'euclidean' then -sqrt({SQD}) when q.part = 'angular' then -acos(greatest(-1.0, least(1.0, {DOT}))) else -acosh(greatest({_RAW.format(s=SQD)}, 1.0)) end, 9) score from v q join v d on q.part = d.part and q.lang <> 'en' and d.lang = 'en')",
         "r as (select part, query_id, doc_id, row_number() over (partition by part, query_id order by score desc, doc_id) r from s qualify r <= 10)",
         "p as (select a.part, a.query_id, k, sum((a.doc_id <> b.doc_id)::int) bad from r a join r b on b.part = 'cosine' and a.query_id = b.query_id and a.r = b.r, (select unnest([1, 3, 10]) k) where a.r <= k and a.part <> 'cosine' group by 1, 2, 3)")
    + "select part metric, k, count(*) n, round(avg((bad = 0)::int), 4) identical, sum(bad)::bigint positions_differing from p group by 1, 2"
)
def metric_lists(spark, d):
    """Share of identical top lists, and differing places, of each metric and curvature against cosine.

    Poincare distances are between unit vectors drawn into the ball at the radius of their curvature.
    """
    c = X.vectors(spark, d)
    out = None
    kinds = [("cosine", "cosine", None), ("euclidean", "euclid", None), ("angular", "angular", None), *[(f"poincare c={x}", "poincare", x) for x in CURVATURES]]
    for name, metric, curvature in kinds:
        v = c if curvature is None else c.withColumn("vec", V.scaled("vec", F.tanh(F.sqrt(F.lit(curvature))) / F.sqrt(F.lit(curvature))))
        h = knn(v.where(F.col("lang") != X.PIVOT), v.where(F.col("lang") == X.PIVOT), max(KS), metric).select(F.lit(name).alias("metric"), "query_id", "rank", "doc_id")
        out = h if out is None else out.union(h)
    base = F.max(F.when(F.col("metric") == "cosine", F.col("doc_id"))).over(Window.partitionBy("query_id", "rank"))
    bad = out.withColumn("bad", (F.col("doc_id") != base).cast("long")).where("metric <> 'cosine'").withColumn("k", F.explode(F.array(*map(F.lit, KS)))).where("rank <= k")
    per = bad.groupBy("metric", "k", "query_id").agg(F.sum("bad").alias("bad"))
    return per.groupBy("metric", "k").agg(F.count("*").alias("n"), r4(F.avg((F.col("bad") == 0).cast("double"))).alias("identical"), F.sum("bad").alias("positions_differing"))


@query(
    ctes(CORPUS, offs(), shifted("s", [0.0, 0.75]), oknn("hits", "s", "s", 10), J, "t as (select query_id, q_concept, part, sum((match and lang = 'en')::int) g from j group by 1, 2, 3)",
         "g as (select a.query_id, a.q_concept concept, b.g - a.g gain, b.g correct from t a join t b using (query_id) where a.part = '0.0' and b.part = '0.75')")
    + "select query_id, concept, gain::bigint gain, correct::bigint correct, row_number() over (order by gain desc, correct desc, query_id)::bigint place from g qualify place <= 200"
)
def demo_ranking(spark, d):
    """The 200 queries that the shift helps most, over all concepts (a top-k report)."""
    c = X.vectors(spark, d)
    s = S.sweep(c, S.offsets(c, X.PIVOT), [0.0, 0.75])
    good = F.col("match") & (F.col("lang") == X.PIVOT)
    t = M.judged(knn(s, s, 10), c.drop("vec")).groupBy("query_id", F.col("q_concept").alias("concept")).agg(*[F.sum((good & (F.col("part") == p)).cast("long")).alias(n) for p, n in (("0.0", "off"), ("0.75", "correct"))])
    best = t.withColumn("gain", F.col("correct") - F.col("off")).orderBy(F.col("gain").desc(), F.col("correct").desc(), "query_id").limit(200)
    place = F.row_number().over(Window.orderBy(F.col("gain").desc(), F.col("correct").desc(), "query_id")).cast("long")  # of 200 rows
    return best.withColumn("place", place).select("query_id", "concept", "gain", "correct", "place")


OVERRIDE = "case when id % 7 = 0 then 'de' when id % 7 = 1 then '' end"


@query(ctes(TOKENS, ALL) + f"select id, {OVERRIDE} \"override\", coalesce(nullif({OVERRIDE}, ''), case when round(margin, 9) >= 0.2 then lang end, 'en') used from z")
def language_used(spark, d):
    """The language to search in: a given one, else the confident detection, else the pivot."""
    from ..operators import lexical as L

    docs = X.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    z = L.identify(docs, *L.document_frequency(docs)).withColumn("override", F.expr(OVERRIDE))
    return z.select("id", "override", L.chosen_language("override", "lang", "confident", X.PIVOT).alias("used"))


@query(ctes(TAX) + "select id, full_path, depth, array_to_string(parts[1:depth], ' > ') ancestors from tax")
def panel_ancestors(spark, d):
    """The ancestors of every category, root first, as the panels show them."""
    return X.taxonomy(spark, d).select("id", "full_path", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), " > ").alias("ancestors"))


# the disk: two coordinates of the nodes' points, drawn at their hyperbolic radius
FLAT = "fl as (select code, parent, \"level\", vec[1:2] v from nodes), rm as (select quantile_cont(2 * atanh(least(sqrt(list_inner_product(v, v)), 1 - 1e-12)), 0.995) m from fl)"


def _drawn(v: str) -> str:
    n = f"least(sqrt(list_inner_product({v}, {v})), 1 - 1e-12)"
    return f"case when {n} < 1e-12 then 0 else least(2 * atanh({n}) / m, 1.0) / {n} end"


def _disk(spark, d):
    n = _nodes(spark, d).select("code", "parent", "level", F.slice("vec", 1, 2).alias("v"))
    return n, F.broadcast(n.agg(F.percentile(V.radius(V.norm("v")), F.lit(0.995)).alias("m")))  # one row


@query(
    ctes(*TREE_BALL, FLAT, f"c as (select a.code, b.code node, b.\"level\"::int \"level\", b.v, {_drawn('b.v')} k, 2 * atanh(least(sqrt(list_inner_product(b.v, b.v)), 1 - 1e-12)) r from fl a join fl b on starts_with(a.code, b.code) and length(a.code) >= length(b.code), rm)")
    + "select code, node, \"level\", round(v[1] * k, 4) + 0.0 x, round(v[2] * k, 4) + 0.0 y, round(r, 2) radius from c"
)
def disk_chain(spark, d):
    """For every node its chain from the root, drawn, with radii."""
    n, rm = _disk(spark, d)
    up = n.select("code", F.explode(T.ancestors("code")).alias("node")).join(n.select(F.col("code").alias("node"), "level", "v"), "node")
    return V.warped(up.crossJoin(rm), "v", F.col("m")).select("code", "node", "level", r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"), F.round(V.radius(V.norm("v")), 2).alias("radius"))


GEO2 = [
    "g1 as (select *, list_transform(u, lambda x: -x) m1 from g0)", _mob("w", "g1", "m1", "v"), "st as (select *, sqrt(list_inner_product(w_x, w_x)) wn, unnest(range(0, 64)) step from w)",
    "sc as (select *, list_transform(w_x, lambda x: x * case when wn < 1e-12 then 0 else tanh(step / 63.0::double * atanh(least(wn, 1 - 1e-12))) / wn end) s from st)", _mob("gg", "sc", "u", "s"),
]


@query(
    ctes(*TREE_BALL, FLAT, "g0 as (select a.code, a.\"level\" lv, p.v u, a.v v from fl a join fl p on p.code = a.parent)", *GEO2, f"dr as (select code, lv, step, gg_x, {_drawn('gg_x')} k from gg, rm)", "edges as (select code, lv, step, round(gg_x[1] * k, 4) + 0.0 x, round(gg_x[2] * k, 4) + 0.0 y from dr)")
    + "select n.code, (e.lv - 2)::bigint segment, e.step, x, y from fl n join edges e on starts_with(n.code, e.code) and not (e.lv > 2 and e.step = 0)"
)
def disk_path(spark, d):
    """For every node the drawn geodesic through its chain: 64 points a segment, a later segment without its first."""
    n, rm = _disk(spark, d)
    edge = n.select("code", "parent", "level", F.col("v").alias("b")).join(n.select(F.col("code").alias("parent"), F.col("v").alias("a")), "parent")
    g = V.warped(V.geodesic(edge, "p", "a", "b").crossJoin(rm), "p", F.col("m")).select(F.col("code").alias("end"), (F.col("level") - 2).cast("long").alias("segment"), "step", r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"))
    chain = n.select("code", F.explode(T.ancestors("code")).alias("end"))
    return chain.join(g, "end").where("segment = 0 or step > 0").drop("end")


@query(
    ctes(*TREE_BALL, FLAT, "sib as (select a.code, b.code sibling, row_number() over (partition by a.code order by b.code) r from fl a join fl b on a.parent = b.parent and a.code <> b.code qualify r <= 3)",
         "g0 as (select s.code, s.sibling, a.v u, b.v v, p.v pv, a.parent from sib s join fl a on a.code = s.code join fl b on b.code = s.sibling join fl p on p.code = a.parent)", *GEO2)
    + "select code, sibling, step, round(2 * atanh(least(sqrt(list_inner_product(gg_x, gg_x)), 1 - 1e-12)), 3) radius, parent, round(2 * atanh(least(sqrt(list_inner_product(pv, pv)), 1 - 1e-12)), 2) parent_radius from gg"
)
def sibling_profile(spark, d):
    """Radius along the geodesics from a node to its first three siblings, beside the parent's radius."""
    n, _ = _disk(spark, d)
    few = n.where("parent is not null").groupBy("parent").agg(F.slice(F.array_sort(F.collect_list("code")), 1, 4).alias("s"))  # collect_list: children of one node of a code tree
    first = F.slice(F.filter("s", lambda x: x != F.col("code")), 1, 3)
    pair = n.join(few, "parent").select("code", "parent", F.col("v").alias("u"), F.explode(first).alias("sibling"))
    pair = pair.join(n.select(F.col("code").alias("sibling"), F.col("v").alias("w")), "sibling").join(n.select(F.col("code").alias("parent"), F.round(V.radius(V.norm("v")), 2).alias("parent_radius")), "parent")
    return V.geodesic(pair, "p", "u", "w").select("code", "sibling", "step", F.round(V.radius(V.norm("p")), 3).alias("radius"), "parent", "parent_radius")


SEED = "(id * 7919 + 104729) % 1000003"


@query(
    ctes(BALL, RAD, ZED, f"pk as (select *, row_number() over (order by {SEED}, id) s, row_number() over (order by round(z, 9), id) lo, row_number() over (order by round(z, 9) desc, id) hi from z)")
    + "select id, label, round(r, 2) radius, round(z, 1) + 0.0 z, s <= 150 sampled, lo <= 8 too_general, hi <= 8 too_specific from pk where s <= 150 or lo <= 8 or hi <= 8"
)
def depth_scatter(spark, d):
    """A seeded sample of depth against radius, with the eight most and least specific rows (top-k reports)."""
    z = _robust(spark, d).withColumn("zr", F.round("z", 9))
    picks = {"sampled": z.orderBy(F.expr(SEED), "id").limit(150), "too_general": z.orderBy("zr", "id").limit(8), "too_specific": z.orderBy(F.col("zr").desc(), "id").limit(8)}
    tags = None
    for name, x in picks.items():
        x = x.select("id", F.lit(name).alias("t"))
        tags = x if tags is None else tags.union(x)
    tags = tags.groupBy("id").agg(F.collect_set("t").alias("t"))  # at most three of a row
    return z.join(F.broadcast(tags), "id").select("id", "label", F.round("r", 2).alias("radius"), (F.round("z", 1) + 0.0).alias("z"), *[F.array_contains("t", n).alias(n) for n in picks])
