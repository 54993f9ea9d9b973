"""Hyperbolic geometry, hierarchy metrics and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..operators import metrics as M
from ..operators import stats as St
from ..operators.knn import knn, ranked
from ..sources import fixtures as X
from .oracle import BALL, CORPUS, SQD, TREE, ctes, knn as oknn, nrm, poincare, query

r4 = M.r4
NB = "list_inner_product(vec, vec)"


def _ball(spark, d):
    return X.ball(spark, d).select(F.col("vec_id").alias("id"), "label", F.col("x").alias("vec"))


@query(
    ctes(BALL) + f"select id, round(sqrt({NB}), 4) n, round(2 * atanh(least(sqrt({NB}), 1 - 1e-12)), 4) radius, round(list_inner_product(list_transform(vec, lambda x: x * 3), list_transform(vec, lambda x: x * 3 * least(1.0, (1 - 1e-6) / greatest(3 * sqrt({NB}), 1e-12)))), 4) clamped, "
    f"round(sqrt(list_inner_product(vec[1:2], vec[1:2])), 4) cut_norm, round(tanh(1.0) * vec[1], 4) + 0.0 exp0 from ball"
)
def ball_scalars(spark, d):
    """Norm, hyperbolic radius, clamping, truncation, exponential map."""
    b = _ball(spark, d).withColumn("big", V.scaled("vec", F.lit(3.0)))
    return b.select("id", r4(V.norm("vec")).alias("n"), r4(V.radius(V.norm("vec"))).alias("radius"), r4(V.dot("big", V.clamped("big"))).alias("clamped"), r4(V.norm(F.slice("vec", 1, 2))).alias("cut_norm"), r4(F.get(V.exp0("vec"), F.lit(0))).alias("exp0"))


@query(
    ctes(BALL, "p as (select q.id a, d.id b, q.vec u, d.vec v from ball q join ball d on d.label = q.label and d.id > q.id)")
    + f"select a, b, round(list_inner_product(u, v), 4) + 0.0 dot, round(sqrt(list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 4) euclid, round({poincare('u', 'v')}, 4) hyp, round(acos(greatest(-1.0, least(1.0, list_inner_product(u, v)))), 4) angle from p"
)
def pair_distances(spark, d):
    """Dot, Euclidean, Poincare and angular distance of pairs within a level."""
    b = X.ball(spark, d).select("vec_id", "label", F.col("x").alias("u"))
    p = b.select(F.col("vec_id").alias("a"), "label", "u").join(b.select(F.col("vec_id").alias("b"), "label", F.col("u").alias("v")), "label").where("b > a")
    return p.select("a", "b", r4(V.dot("u", "v")).alias("dot"), r4(V.euclid("u", "v")).alias("euclid"), r4(V.poincare("u", "v")).alias("hyp"), r4(V.angular("u", "v")).alias("angle"))


@query(
    ctes(BALL, "f as (select label, arg_min(vec, id) u, arg_max(vec, id) v, min(id) a, max(id) b from ball group by 1)")
    + "select label, round(" + poincare("u", "v") + ", 4) direct, round(acosh(greatest(1 + 2 * e / (a1 * b1), 1.0)), 4) cut, round(acosh(greatest(1 + 2 * e / (a1 * b1), 1 + 1e-7)), 4) cut_floor, round(acosh(1 + 2 * e / greatest(a1 * b1, 1e-12)), 4) floor_den, "
    "round(acosh(1 + 2 * greatest(uu + vv - 2 * uv, 0) / greatest((1 - uu) * (1 - vv), 1e-12)), 4) gram, "
    "round(acosh(greatest(1 + 2 * f / (1e-9 * 1e-9), 1.0)), 4) edge_direct, round(acosh(greatest(1 + 2 * f / (1e-5 * 1e-5), 1 + 1e-7)), 4) edge_cut_floor, round(acosh(1 + 2 * f / 1e-12), 4) edge_floor_den from "
    "(select *, list_sum(list_transform(list_zip(u, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) e, 1 - least(list_inner_product(u, u), 1 - 1e-5) a1, 1 - least(list_inner_product(v, v), 1 - 1e-5) b1, list_inner_product(u, u) uu, list_inner_product(v, v) vv, list_inner_product(u, v) uv, "
    "list_sum(list_transform(list_zip(u, v), lambda p: (p[1] / sqrt(list_inner_product(u, u)) - p[2] / sqrt(list_inner_product(v, v))) ** 2)) f from f)"
)
def poincare_variants(spark, d):
    """The five clamp variants: alike inside the ball, apart on its edge, where each has a limit of its own."""
    f = _ball(spark, d).groupBy("label").agg(F.min_by("vec", "id").alias("u"), F.max_by("vec", "id").alias("v"))
    f = f.withColumns({"eu": V.scaled("u", 1 / V.norm("u")), "ev": V.scaled("v", 1 / V.norm("v"))})
    gram = F.acosh(1 + 2 * F.greatest(V.dot("u", "u") + V.dot("v", "v") - 2 * V.dot("u", "v"), F.lit(0.0)) / F.greatest((1 - V.dot("u", "u")) * (1 - V.dot("v", "v")), F.lit(1e-12)))
    variants = {"direct": V.poincare("u", "v"), "cut": V.poincare("u", "v", 1 - 1e-5, 1.0), "cut_floor": V.poincare("u", "v", 1 - 1e-5, 1 + 1e-7), "floor_den": V.poincare("u", "v", 1.0, 1.0, 1e-12), "gram": gram}
    edge = {"edge_direct": V.poincare("eu", "ev"), "edge_cut_floor": V.poincare("eu", "ev", 1 - 1e-5, 1 + 1e-7), "edge_floor_den": V.poincare("eu", "ev", 1.0, 1.0, 1e-12)}
    return f.select("label", *[r4(x).alias(n) for n, x in {**variants, **edge}.items()])


def _mob(name, src, u, v):
    return (
        f"{name}0 as (select *, list_inner_product({u}, {v}) uv, list_inner_product({u}, {u}) uu, list_inner_product({v}, {v}) vv from {src}), "
        f"{name} as (select * exclude (uv, uu, vv), list_transform(list_zip({u}, {v}), lambda p: ((1 + 2 * uv + vv) * p[1] + (1 - uu) * p[2]) / greatest(1 + 2 * uv + uu * vv, 1e-12)) {name}_x from {name}0)"
    )


GEO = [
    BALL, "g0 as (select label, arg_min(vec, id) u, arg_max(vec, id) v from ball group by 1)", "g1 as (select *, list_transform(u, lambda x: -x) m from g0)", _mob("w", "g1", "m", "v"),
    "st as (select *, sqrt(list_inner_product(w_x, w_x)) wn, unnest(range(0, 64)) step from w)",
    "sc as (select *, list_transform(w_x, lambda x: x * case when wn < 1e-12 then 0 else tanh(step / 63.0::double * atanh(least(wn, 1 - 1e-12))) / wn end) s from st)", _mob("gg", "sc", "u", "s"),
]


@query(ctes(*GEO) + "select label, step, round(gg_x[1], 4) + 0.0 x1, round(2 * atanh(least(sqrt(list_inner_product(gg_x, gg_x)), 1 - 1e-12)), 3) radius from gg")
def geodesics(spark, d):
    """64 points of the geodesic between the outer points of each level, with radii."""
    f = _ball(spark, d).groupBy("label").agg(F.min_by("vec", "id").alias("u"), F.max_by("vec", "id").alias("v"))
    g = V.geodesic(f, "p", "u", "v")
    return g.select("label", "step", r4(F.get("p", F.lit(0))).alias("x1"), F.round(V.radius(V.norm("p")), 3).alias("radius"))


RAD = f"rad as (select id, label, vec, 2 * atanh(least(sqrt({NB}), 1 - 1e-12)) r from ball)"


@query(
    ctes(BALL, RAD, "two as (select id, label, vec[1:2] v, sqrt(list_inner_product(vec[1:2], vec[1:2])) n2 from ball)", "rm as (select quantile_cont(2 * atanh(least(n2, 1 - 1e-12)), 0.995) m from two)")
    + "select id, round(v[1] * k, 4) + 0.0 x, round(v[2] * k, 4) + 0.0 y, round(m, 2) r_max from (select *, least(2 * atanh(least(n2, 1 - 1e-12)) / m, 1.0) / n2 k from two, rm)"
)
def disk_view(spark, d):
    """Points drawn at their hyperbolic radius, relative to the 99.5th percentile."""
    b = _ball(spark, d).select("id", F.slice("vec", 1, 2).alias("v"))
    rm = F.broadcast(b.agg(F.percentile(V.radius(V.norm("v")), F.lit(0.995)).alias("m")))
    return V.warped(b.crossJoin(rm), "v", F.col("m")).select("id", r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"), F.round("m", 2).alias("r_max"))


ZED = (
    "md as (select label, median(r) m from rad group by 1), mad as (select label, median(abs(r - m)) a, any_value(m) m from rad join md using (label) group by 1), "
    "kids as (select a.id, count(b.id) kids from rad a left join rad b on b.label = a.label + 1 and b.id % 10 = a.id % 10 group by 1), "
    "z as (select id, label, r, (r - m) / (1.4826::double * case when a = 0 then 1e-9 else a end) z from rad join mad using (label))"
)


def _robust(spark, d):
    r = _ball(spark, d).select("id", "label", V.radius(V.norm("vec")).alias("r"))
    md = r.groupBy("label").agg(F.median("r").alias("m"))
    j = r.join(F.broadcast(md), "label")  # a row a level
    mad = j.groupBy("label").agg(F.median(F.abs(F.col("r") - F.col("m"))).alias("a"))
    return j.join(F.broadcast(mad), "label").select("id", "label", "r", ((F.col("r") - F.col("m")) / (1.4826 * F.when(F.col("a") == 0, 1e-9).otherwise(F.col("a")))).alias("z"))


@query(ctes(BALL, RAD, ZED) + "select id, label, round(r, 4) r, round(z, 4) + 0.0 z from z")
def robust_z(spark, d):
    """Radius against the median and spread of its level."""
    return _robust(spark, d).select("id", "label", r4(F.col("r")).alias("r"), r4(F.col("z")).alias("z"))


@query(ctes(BALL, RAD, ZED) + "select * from (select 'too_general' kind, id, round(z, 4) z from z order by round(z, 9), id limit 8) union all select * from (select 'too_specific', id, round(z, 4) from z order by round(z, 9) desc, id limit 8)")
def anomaly_lists(spark, d):
    z = _robust(spark, d).withColumn("k", F.round("z", 9))
    low = z.orderBy("k", "id").limit(8).select(F.lit("too_general").alias("kind"), "id", r4(F.col("z")).alias("z"))
    return low.union(z.orderBy(F.col("k").desc(), "id").limit(8).select(F.lit("too_specific"), "id", r4(F.col("z"))))


@query(ctes(BALL, RAD, ZED) + "select case when label = 9 then 'leaf' else 'hub' end kind, count(*) n, round(avg(z), 4) mean_z, sum((abs(z) > 2.5)::int)::bigint over_2_5, sum((abs(z) > 4)::int)::bigint over_4 from z group by 1")
def leaf_hub_means(spark, d):
    z = _robust(spark, d)
    g = z.groupBy(F.when(F.col("label") == 9, "leaf").otherwise("hub").alias("kind"))
    return g.agg(F.count("*").alias("n"), r4(F.avg("z")).alias("mean_z"), F.sum((F.abs("z") > 2.5).cast("long")).alias("over_2_5"), F.sum((F.abs("z") > 4).cast("long")).alias("over_4"))


@query(
    ctes(BALL, RAD, "k as (select id, row_number() over (order by round(r, 9), id) ra, row_number() over (order by label, id) rb, row_number() over (order by round(vec[1], 9), id) rc from rad)", "c as (select corr(ra, rb) ab, corr(ra, rc) ac, corr(rb, rc) bc from k)")
    + "select round(ab, 4) rho, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 4) partial_rho from c"
)
def rank_correlation(spark, d):
    """Spearman of radius and level, and without what a third column explains."""
    b = _ball(spark, d).select("id", "label", F.round(V.radius(V.norm("vec")), 9).alias("r"), F.round(F.get("vec", F.lit(0)), 9).alias("c"))
    k = St.ranked(b, ["r", "label", "c"], "id")
    c = k.agg(F.corr("r_r", "r_label").alias("ab"), F.corr("r_r", "r_c").alias("ac"), F.corr("r_label", "r_c").alias("bc"))
    return c.select(r4(F.col("ab")).alias("rho"), r4(St.partial(F.col("ab"), F.col("ac"), F.col("bc"))).alias("partial_rho"))


@query(ctes(BALL, RAD, "l as (select label, avg(r) m, count(*) n from rad group by 1)", "g as (select avg(r) gm from rad)", "k as (select *, lag(m) over (order by label) prev from l)") + "select round((select sum(n * (m - gm) * (m - gm)) from l, g) / (select sum((r - gm) * (r - gm)) from rad, g), 4) eta2, (select bool_and(prev is null or m >= prev) from k) monotone, (select count(*) from l) levels")
def eta_squared(spark, d):
    """Share of the radius' variance between levels, and whether level means rise."""
    r = _ball(spark, d).select("label", V.radius(V.norm("vec")).alias("r"))
    g = F.broadcast(r.agg(F.avg("r").alias("gm")))
    l = r.crossJoin(g).groupBy("label").agg(F.avg("r").alias("m"), F.count("*").alias("n"), F.first("gm").alias("gm"), F.sum((F.col("r") - F.col("gm")) * (F.col("r") - F.col("gm"))).alias("ss"))
    k = l.withColumn("prev", F.lag("m").over(Window.orderBy("label")))  # a row a level
    between = F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm")))
    return k.agg(r4(between / F.sum("ss")).alias("eta2"), F.bool_and(F.col("prev").isNull() | (F.col("m") >= F.col("prev"))).alias("monotone"), F.count("*").alias("levels"))


@query(ctes(BALL, RAD) + "select label, count(*) n, round(avg(r), 2) mean_radius from rad group by 1")
def mean_radius(spark, d):
    return _ball(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.radius(V.norm("vec"))), 2).alias("mean_radius"))


# tree nodes as points: the k-th code (in order) is the k-th point of the ball
NODES = "nodes as (select t.code, t.parent, t.\"level\", b.id, b.vec, '' part from (select *, row_number() over (order by code) k from tree) t join (select *, row_number() over (order by id) k from ball) b using (k))"
TREE_BALL = [TREE, BALL, NODES]


def _nodes(spark, d):
    t = X.tree(spark, d).withColumn("k", F.row_number().over(Window.orderBy("code")))  # stands in for an aligned matrix
    # as many points as there are codes: a distributed top-n, then a window over a code tree's rows
    b = _ball(spark, d).orderBy("id").limit(t.count()).withColumn("k", F.row_number().over(Window.orderBy("id")))
    return t.join(b, "k").select("code", "parent", "level", "id", "vec")


def _kin(a, b, pa, pb):
    return b.startswith(a) | a.startswith(b) | F.coalesce(pa == pb, F.lit(False))


@query(ctes(*TREE_BALL, oknn("h", "nodes", "nodes", 6, f"-{poincare()}"), oknn("e", "nodes", "nodes", 6, f"-sqrt({SQD})")) + "select 'hyperbolic' geometry, q.code, n.code neighbour, \"rank\"::bigint \"rank\", round(-score, 4) + 0.0 dist, starts_with(q.code, n.code) or starts_with(n.code, q.code) or coalesce(q.parent = n.parent, false) kin from h join nodes q on q.id = query_id join nodes n on n.id = doc_id union all select 'flat', q.code, n.code, \"rank\", round(-score, 4) + 0.0, starts_with(q.code, n.code) or starts_with(n.code, q.code) or coalesce(q.parent = n.parent, false) from e join nodes q on q.id = query_id join nodes n on n.id = doc_id")
def neighbours_kin(spark, d):
    """Six neighbours of every node in both geometries, flagged ancestor, descendant or sibling."""
    n = _nodes(spark, d)
    a, b = n.select(F.col("id").alias("query_id"), "code", F.col("parent").alias("pa")), n.select(F.col("id").alias("doc_id"), F.col("code").alias("neighbour"), F.col("parent").alias("pb"))
    out = None
    for name, m in (("hyperbolic", "poincare"), ("flat", "euclid")):
        h = knn(n, n, 6, m).withColumn("geometry", F.lit(name))
        out = h if out is None else out.union(h)
    j = out.join(a, "query_id").join(b, "doc_id")
    return j.select("geometry", "code", "neighbour", F.col("rank").cast("long").alias("rank"), r4(-F.col("score")).alias("dist"), _kin(F.col("code"), F.col("neighbour"), F.col("pa"), F.col("pb")).alias("kin"))


@query(ctes(*TREE_BALL, oknn("h", "nodes", "nodes", 10, f"-{poincare()}")) + "select k, count(distinct query_id) n, round(avg(kin), 4) kin_at_k from (select query_id, \"rank\", (starts_with(q.code, n.code) or starts_with(n.code, q.code) or coalesce(q.parent = n.parent, false))::int kin from h join nodes q on q.id = query_id join nodes n on n.id = doc_id), (select unnest([6, 10]) k) where \"rank\" <= k group by 1")
def kin_at_k(spark, d):
    n = neighbours(spark, d, 10)
    return n.withColumn("k", F.explode(F.array(F.lit(6), F.lit(10)))).where("rank <= k").groupBy("k").agg(F.countDistinct("query_id").alias("n"), r4(F.avg(F.col("kin").cast("double"))).alias("kin_at_k"))


def neighbours(spark, d, k):
    n = _nodes(spark, d)
    a, b = n.select(F.col("id").alias("query_id"), F.col("code").alias("ca"), F.col("parent").alias("pa")), n.select(F.col("id").alias("doc_id"), F.col("code").alias("cb"), F.col("parent").alias("pb"))
    return knn(n, n, k, "poincare").join(a, "query_id").join(b, "doc_id").withColumn("kin", _kin(F.col("ca"), F.col("cb"), F.col("pa"), F.col("pb")))


MAPQ = (
    "o as (select q.id query_id, q.code ca, n.code cb, row_number() over (partition by q.id order by round({e}, 9), n.id) rk from nodes q join nodes n on q.id <> n.id) , "
    "dirs as (select unnest(['ancestor', 'parent', 'descendant']) dir), "
    "hh as (select dir, query_id, rk, case dir when 'ancestor' then starts_with(ca, cb) when 'descendant' then starts_with(cb, ca) else cb = (select parent from nodes x where x.id = query_id) end hit from o, dirs), "
    "pp as (select dir, query_id, rk, sum(hit::int) over (partition by dir, query_id order by rk) / rk::double prec, hit from hh), ap as (select dir, query_id, sum(prec) / count(*) ap from pp where hit group by 1, 2)"
).replace("{e}", poincare("q.vec", "n.vec"))


@query(ctes(*TREE_BALL, MAPQ) + "select dir direction, count(*) n, round(avg(ap), 4) map from ap group by 1")
def tree_map(spark, d):
    """Mean average precision of ancestors, parents and descendants by ascending distance."""
    n = _nodes(spark, d)
    every = knn(n, n, 10**6, "poincare")  # the metric ranks all other nodes
    a = n.select(F.col("id").alias("query_id"), F.col("code").alias("ca"), F.col("parent").alias("pa"))
    j = every.join(a, "query_id").join(n.select(F.col("id").alias("doc_id"), F.col("code").alias("cb")), "doc_id")
    out = None
    for name, hit in (("ancestor", F.col("ca").startswith(F.col("cb"))), ("parent", F.coalesce(F.col("cb") == F.col("pa"), F.lit(False))), ("descendant", F.col("cb").startswith(F.col("ca")))):
        ap = M.average_precision(j.withColumn("hit", hit)).agg(F.count("*").alias("n"), r4(F.avg("ap")).alias("map")).withColumn("direction", F.lit(name))
        out = ap if out is None else out.union(ap)
    return out


@query(ctes(*TREE_BALL, MAPQ, "nd as (select q.id, q.code, (select count(*) from nodes x where x.code <> q.code and starts_with(x.code, q.code)) c from nodes q)") + "select nd.code, c::bigint n_descendants, round(ap, 4) ap from nd join ap on ap.query_id = nd.id and dir = 'descendant' order by c desc, nd.code limit 5")
def hub_precision(spark, d):
    """Average precision of the five nodes with the most descendants."""
    n = _nodes(spark, d)
    every = knn(n, n, 10**6, "poincare")
    j = every.join(n.select(F.col("id").alias("query_id"), F.col("code").alias("ca")), "query_id").join(n.select(F.col("id").alias("doc_id"), F.col("code").alias("cb")), "doc_id")
    ap = M.average_precision(j.withColumn("hit", F.col("cb").startswith(F.col("ca"))))
    return ap.join(n.select(F.col("id").alias("query_id"), "code"), "query_id").orderBy(F.col("npos").desc(), "code").limit(5).select("code", F.col("npos").alias("n_descendants"), r4(F.col("ap")).alias("ap"))


@query(
    ctes(*TREE_BALL)
    + "select code, \"level\"::int \"level\", parent, (select count(*) from tree x where x.parent = nodes.code) n_children, round(vec[1], 5) + 0.0 x, round(vec[2], 5) + 0.0 y, "
    "round(embedding[1]::double, 5) + 0.0 flat_x, round(embedding[2]::double, 5) + 0.0 flat_y, round(2 * atanh(least(sqrt(list_inner_product(vec, vec)), 1 - 1e-12)), 3) radius "
    "from nodes join embeddings on vec_id = id order by code limit 600"
)
def tree_geometry(spark, d):
    """Nodes with children, coordinates in the ball and in the flat space, and radius, in code order, up to 600."""
    kids = X.tree(spark, d).where("parent is not null").groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("n_children"))
    n = _nodes(spark, d).join(kids, "code", "left").fillna(0, ["n_children"]).orderBy("code").limit(600)
    flat = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in ((0, "flat_x"), (1, "flat_y"))])
    at = {"x": F.get("vec", F.lit(0)), "y": F.get("vec", F.lit(1)), "flat_x": F.col("flat_x"), "flat_y": F.col("flat_y")}
    return n.join(flat, "id").select("code", "level", "parent", "n_children", *[(F.round(v, 5) + 0.0).alias(k) for k, v in at.items()], F.round(V.radius(V.norm("vec")), 3).alias("radius"))


@query(
    ctes(BALL, "tx as (select vec_id id, '' part, list_transform(embedding, lambda x: x::double) vec from embeddings)", oknn("hp", "ball", "ball", 10, f"-{poincare()}"), oknn("eu", "ball", "ball", 10, f"-sqrt({SQD})"), oknn("co", "tx", "tx", 10))
    + "select 'hyperbolic' panel, query_id, doc_id, \"rank\"::bigint \"rank\" from hp union all select 'euclidean', query_id, doc_id, \"rank\" from eu union all select 'text', query_id, doc_id, \"rank\" from co"
)
def three_panels(spark, d):
    """Neighbours of every row in three spaces, joined by id."""
    b = _ball(spark, d)
    t = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    out = None
    for name, x, m in (("hyperbolic", b, "poincare"), ("euclidean", b, "euclid"), ("text", t, "cosine")):
        h = knn(x, x, 10, m).select(F.lit(name).alias("panel"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
        out = h if out is None else out.union(h)
    return out


@query(
    ctes(CORPUS, "m as (select avg(sqrt(list_inner_product(vec[1:5], vec[1:5]))) mn from corpus)", "x as (select id, lang, concept, vec[1:5] v, sqrt(list_inner_product(vec[1:5], vec[1:5])) n, mn from corpus, m)",
         "s as (select unnest([0.5, 1.0, 2.0])::double s)", "b as (select s::varchar part, id, lang, concept, list_transform(v, lambda z: z * tanh(s * n / mn) / n) vec from x, s)", "qs as (select * from b where lang <> 'en')", "ds as (select * from b where lang = 'en')", oknn("h", "qs", "ds", 3, f"-{poincare()}"))
    + "select part::double scale, count(*) / 3 n, round(sum((q.concept = c.concept)::int) / (count(*) / 3)::double, 4) hits3 from h join corpus q on q.id = query_id join corpus c on c.id = doc_id group by 1"
)
def ball_retrieval(spark, d):
    """Retrieval in the ball by the scale of a direction-preserving map."""
    c = X.vectors(spark, d).withColumn("v", F.slice("vec", 1, 5)).withColumn("n", V.norm("v"))
    m = F.broadcast(c.agg(F.avg("n").alias("mn")))
    b = c.crossJoin(m).withColumn("s", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0)])))
    b = b.withColumn("k", F.tanh(F.col("s") * F.col("n") / F.col("mn")) / F.col("n")).withColumn("part", F.col("s").cast("string")).select("part", "id", "lang", V.scaled("v", F.col("k")).alias("vec"))
    h = knn(b.where("lang <> 'en'"), b.where("lang = 'en'"), 3, "poincare")
    j = M.judged(h, c.select("id", "concept", "lang"))
    return j.groupBy(F.col("part").cast("double").alias("scale")).agg((F.count("*") / 3).alias("n"), r4(F.sum(F.col("match").cast("int")) / (F.count("*") / 3)).alias("hits3"))
