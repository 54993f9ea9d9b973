"""Vector retrieval: offsets, nearest neighbours, prefetch, rerank, and their metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import metrics as M
from ..operators import shift as S
from ..operators.knn import knn, prefixes, ranked, streamed
from ..sources import fixtures as X
from .oracle import BALL, CORPUS, DOT, SQD, ctes, knn as oknn, nrm, offs, poincare, query, shifted

ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
r4 = M.r4
PER = "per as (select h.part, q.lang, h.query_id, q.concept, max((d.concept = q.concept)::int)::double hit, sum((d.concept = q.concept and d.lang = 'en')::int)::double tgt from hits h join corpus q on q.id = h.query_id join corpus d on d.id = h.doc_id where h.\"rank\" <= 10 group by 1, 2, 3, 4)"
J = "j as (select h.*, q.lang q_lang, q.concept q_concept, d.lang, d.concept, d.concept = q.concept as match from hits h join corpus q on q.id = h.query_id join corpus d on d.id = h.doc_id)"


def _sweep_hits(spark, d, k=10, alphas=ALPHAS):
    c = X.vectors(spark, d)
    s = S.sweep(c, S.offsets(c, X.PIVOT), alphas)
    return c, knn(s, s, k)


@query(ctes(CORPUS, offs()) + "select lang, pos, round(m, 4) + 0.0 off from offs_m")
def shift_offsets(spark, d):
    o = S.offsets(X.vectors(spark, d), X.PIVOT)
    return o.select("lang", F.posexplode("off").alias("p", "x")).select("lang", (F.col("p") + 1).cast("long").alias("pos"), r4(F.col("x")).alias("off"))


@query(ctes(CORPUS, offs(), shifted("s", [0.75])) + "select id, lang, round(list_inner_product(vec, orig), 4) + 0.0 dot_orig, round(vec[1], 4) + 0.0 v1, round(sqrt(list_inner_product(vec, vec)), 4) n from s")
def shift_apply(spark, d):
    c = X.vectors(spark, d).withColumn("orig", F.col("vec"))
    s = S.apply(c, S.offsets(c, X.PIVOT), 0.75)
    return s.select("id", "lang", r4(V.dot("vec", "orig")).alias("dot_orig"), r4(F.get("vec", F.lit(0))).alias("v1"), r4(V.norm("vec")).alias("n"))


@query(ctes(CORPUS, offs(), shifted("s", ALPHAS), oknn("hits", "s", "s", 10), PER) + "select part::double alpha, lang, count(*) n, round(avg(hit), 4) recall, round(avg(tgt), 4) tgt_hits from per group by 1, 2")
def shift_sweep(spark, d):
    c, h = _sweep_hits(spark, d)
    return M.recall_and_hits(M.judged(h, c.drop("vec")), X.PIVOT).withColumn("alpha", F.col("part").cast("double")).drop("part")


IDEAL = "ideal as (select k, sum(1 / log2(i + 1)) s from (select unnest(range(1, 21)) k) a, (select unnest(range(1, 21)) i) b where i <= k group by 1)"


@query(
    ctes(CORPUS, offs(), shifted("s", [0.0, 0.75]), oknn("hits", "s", "s", 20), J, IDEAL,
         "size as (select concept, count(*) r, sum((lang = 'en')::int) rt from corpus group by 1)",
         "p as (select j.part, q_lang, query_id, q_concept, sum(case when match then 1 / log2(\"rank\" + 1) else 0 end) dcg, sum((match and lang = 'en')::int)::double tgt from j group by 1, 2, 3, 4)",
         "z as (select p.*, least(20, r - 1) kk, rt - (q_lang = 'en')::int t from p join size on size.concept = p.q_concept)")
    + "select part::double alpha, q_lang lang, count(*) n, round(avg(case when kk > 0 then dcg / s else 0 end), 4) ndcg20, round(avg(case when t > 0 then tgt / t end), 4) tlr20, round(avg(case when t > 0 then least(t, 20) / t::double end), 4) tlr20_ceiling from z left join ideal on ideal.k = z.kk group by 1, 2"
)
def shift_ndcg(spark, d):
    c, h = _sweep_hits(spark, d, 20, [0.0, 0.75])
    info = c.drop("vec")
    return M.ndcg_and_target(M.judged(h, info), info, X.PIVOT).withColumn("alpha", F.col("part").cast("double")).drop("part")


@query(
    ctes(CORPUS, offs(), shifted("s", ALPHAS), oknn("hits", "s", "s", 10), J,
         "p as (select part, q_lang, query_id, sum(match::int)::double rel, max((match and lang = q_lang)::int)::double same, sum((match and lang <> q_lang)::int)::double oth, avg((lang = q_lang)::int) share from j group by 1, 2, 3)",
         "l as (select count(distinct lang) n from corpus)")
    + "select part::double alpha, coalesce(q_lang, 'all') lang, count(*) n, round(round(avg(rel / l.n), 9), 4) recall, round(round(avg(same), 9), 4) same, round(round(avg(oth / (l.n - 1)), 9), 4) cross_recall, round(round(avg(share), 9), 4) share from p, l group by grouping sets ((part, q_lang), (part))"
)
def taxonomy_recall(spark, d):
    c, h = _sweep_hits(spark, d)
    j = M.judged(h, c.drop("vec"))
    own = F.col("lang") == F.col("q_lang")
    p = j.groupBy("part", "q_lang", "query_id").agg(F.sum(F.col("match").cast("double")).alias("rel"), F.max((F.col("match") & own).cast("double")).alias("same"), F.sum((F.col("match") & ~own).cast("double")).alias("oth"), F.avg(own.cast("double")).alias("share"))
    n = F.broadcast(c.agg(F.countDistinct("lang").alias("nl")))  # one row
    p = p.crossJoin(n)
    means = {"recall": F.avg(F.col("rel") / F.col("nl")), "same": F.avg("same"), "cross_recall": F.avg(F.col("oth") / (F.col("nl") - 1)), "share": F.avg("share")}
    out = [r4(F.round(x, 9)).alias(n) for n, x in means.items()]  # halves fall alike in both engines
    each = p.groupBy("part", F.col("q_lang").alias("lang")).agg(F.count("*").alias("n"), *out)
    return each.union(p.groupBy("part", F.lit("all").alias("lang")).agg(F.count("*").alias("n"), *out)).withColumn("alpha", F.col("part").cast("double")).drop("part")


@query(ctes(CORPUS, "s as (select *, '' part from corpus)", oknn("hits", "s", "s", 10)) + 'select query_id, doc_id, "rank"::bigint "rank", round(score, 4) score from hits')
def knn_cosine(spark, d):
    c = X.vectors(spark, d)
    return knn(c, c, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(F.col("score")).alias("score"))


@query(ctes(CORPUS, "s as (select *, '' part from corpus where lang = 'en')", "q as (select *, '' part from corpus)", oknn("hits", "q", "s", 5)) + 'select query_id, doc_id, "rank"::bigint "rank" from hits')
def knn_prefiltered(spark, d):
    c = X.vectors(spark, d)
    return knn(c, c.where(F.col("lang") == X.PIVOT), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def _ball(spark, d):
    return X.ball(spark, d).select(F.col("vec_id").alias("id"), "label", F.col("x").alias("vec"))


@query(ctes(BALL, oknn("hits", "ball", "ball", 10, f"-sqrt({SQD})")) + 'select query_id, doc_id, "rank"::bigint "rank", round(-score, 4) dist from hits')
def knn_euclid(spark, d):
    b = _ball(spark, d)
    return knn(b, b, 10, "euclid").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(-F.col("score")).alias("dist"))


@query(ctes(BALL, oknn("hits", "ball", "ball", 10, f"-{poincare()}")) + 'select query_id, doc_id, "rank"::bigint "rank", round(-score, 4) dist from hits')
def knn_poincare(spark, d):
    b = _ball(spark, d)
    return knn(b, b, 10, "poincare").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(-F.col("score")).alias("dist"))


FORMULA = "-ln(x + sqrt(greatest(x * x - 1, 0)))"


def _rescored(b, prefetch: int, k: int) -> DataFrame:
    h = knn(b, b, prefetch, "euclid").drop("rank")
    n = b.select(F.col("id"), V.dot("vec", "vec").alias("sq"))
    h = h.join(n.select(F.col("id").alias("query_id"), F.col("sq").alias("q_sq")), "query_id").join(n.select(F.col("id").alias("doc_id"), F.col("sq").alias("d_sq")), "doc_id")
    h = h.withColumns({"dist": -F.col("score")})
    return ranked(h.withColumn("score", F.round(V.formula_score("dist", "q_sq", "d_sq"), 8)), k)


RESCORE = (
    "r0 as (select h.query_id, h.doc_id, 1 + 2 * h.score * h.score / ((1 - list_inner_product(a.vec, a.vec)) * (1 - list_inner_product(b.vec, b.vec))) x from {0} h join ball a on a.id = h.query_id join ball b on b.id = h.doc_id), "
    f"rs as (select query_id, doc_id, round({FORMULA}, 8) score, row_number() over (partition by query_id order by round({FORMULA}, 8) desc, doc_id) \"rank\" from r0 qualify \"rank\" <= 10)"
)


@query(ctes(BALL, oknn("e", "ball", "ball", 50, f"-sqrt({SQD})"), RESCORE.format("e")) + 'select query_id, doc_id, "rank"::bigint "rank", round(score, 4) score from rs')
def prefetch_rescore(spark, d):
    return _rescored(_ball(spark, d), 50, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(F.col("score")).alias("score"))


SIZES = [10, 50, 100, 300, 1000]


@query(
    ctes(BALL, oknn("h", "ball", "ball", 10, f"-{poincare()}"), oknn("e", "ball", "ball", max(SIZES), f"-sqrt({SQD})"),
         "r0 as (select h.query_id, h.doc_id, h.\"rank\" er, 1 + 2 * h.score * h.score / ((1 - list_inner_product(a.vec, a.vec)) * (1 - list_inner_product(b.vec, b.vec))) x from e h join ball a on a.id = h.query_id join ball b on b.id = h.doc_id)",
         f"rs as (select s.size, query_id, doc_id, row_number() over (partition by s.size, query_id order by round({FORMULA}, 8) desc, doc_id) rr from r0, (select unnest({SIZES}) size) s where er <= s.size qualify rr <= 10)")
    + "select size, round(count(h.doc_id) / (10.0 * (select count(*) from ball)), 4) recall10, round((select count(*) from e join h using (query_id, doc_id) where e.\"rank\" <= 10) / (10.0 * (select count(*) from ball)), 4) euclid10 from rs left join h using (query_id, doc_id) group by 1"
)
def prefetch_recall(spark, d):
    """Recall of the ten hyperbolic neighbours by prefetch size (self excluded before, not after)."""
    b = _ball(spark, d)
    exact = knn(b, b, 10, "poincare").select("query_id", "doc_id", F.lit(1).alias("hit"))
    v = b.select("id", "vec", F.array(V.dot("vec", "vec")).alias("more"))

    def lists(_, best):
        def rescored(j, d_sq, s):  # V.formula_score
            x = 1 + 2 * s * s / ((1 - best.more[j]) * (1 - d_sq))
            return np.round(-np.log(x + np.sqrt(np.maximum(x * x - 1, 0.0))), 8)

        yield from prefixes(best, SIZES, 10, rescored)
        yield from (x.set_column(0, "size", pa.array(np.zeros(x.num_rows, np.int32))) for x in prefixes(best, [10], 10, lambda j, _, s: s))

    # the lists of 1,000 stay in their kernel; size 0 has the ten flat neighbours
    top = streamed(v, v, max(SIZES), "euclid", lists, "size int, query_id long, doc_id long, rank int", second=lambda _, d_more: d_more[:, 0])
    n = top.join(exact, ["query_id", "doc_id"], "left").groupBy("size").agg(F.count("hit").alias("hits"))
    flat = F.max(F.when(F.col("size") == 0, F.col("hits"))).over(Window.partitionBy())  # a row a size
    out = n.withColumn("flat", flat).where("size > 0").crossJoin(F.broadcast(b.agg(F.count("*").alias("nq"))))
    return out.select("size", r4(F.col("hits") / (10.0 * F.col("nq"))).alias("recall10"), r4(F.col("flat") / (10.0 * F.col("nq"))).alias("euclid10"))


@query(ctes(BALL) + f"select round(max(abs(-ln(x + sqrt(greatest(x * x - 1, 0))) + dist)), 6) + 0.0 max_error from (select {poincare()} dist, 1 + 2 * {SQD} / ((1 - list_inner_product(q.vec, q.vec)) * (1 - list_inner_product(d.vec, d.vec))) x from ball q join ball d on q.label = d.label)")
def formula_exactness(spark, d):
    """Largest difference of the rescoring formula and the direct distance."""
    b = X.ball(spark, d).select("label", F.col("x").alias("u"))
    p = b.join(b.withColumnRenamed("u", "v"), "label").withColumns({"dist": V.euclid("u", "v"), "q": V.dot("u", "u"), "w": V.dot("v", "v")})
    return p.agg((F.round(F.max(F.abs(V.formula_score("dist", "q", "w") + V.poincare("u", "v"))), 6) + F.lit(0.0)).alias("max_error"))


FACTORS = [1, 2, 4, 8, 16, 32]
LOW = 16


@query(
    ctes(CORPUS, "s as (select *, '' part from corpus)", f"t as (select id, '' part, {nrm(f'vec[1:{LOW}]')} vec from corpus)", oknn("full_", "s", "s", 10), oknn("low", "t", "t", 320),
         "f as (select unnest([1,2,4,8,16,32]) factor)",
         "sc as (select f.factor, l.query_id, l.doc_id, a.score from low l join f on l.\"rank\" <= 10 * f.factor join full__all a on a.query_id = l.query_id and a.doc_id = l.doc_id)",
         "two as (select *, row_number() over (partition by factor, query_id order by score desc, doc_id) r from sc qualify r <= 10)")
    + "select factor, round(count(b.doc_id) / (10.0 * count(distinct two.query_id)), 4) agreement, round(sum((two.r = 1 and b.\"rank\" = 1)::int) / count(distinct two.query_id)::double, 4) same_top, round(avg((c.concept = q.concept)::int), 4) precision10 "
    "from two left join full_ b on b.query_id = two.query_id and b.doc_id = two.doc_id join corpus q on q.id = two.query_id join corpus c on c.id = two.doc_id group by 1"
)
def matryoshka_prefetch(spark, d):
    """Short-vector prefetch, full-length rescore: agreement with the exact ten by prefetch factor."""
    c = X.vectors(spark, d)
    low = V.truncated(c.select("id", F.col("vec").alias("more")), "vec", "more", LOW)
    base = knn(c, c, 10).select("query_id", "doc_id", F.col("rank").alias("base"))

    def lists(_, best):
        return prefixes(best, [10 * f for f in FACTORS], 10, lambda j, full, s: full)

    # the long lists and their full-length products stay in their kernel
    two = streamed(low, low, 10 * max(FACTORS), "cosine", lists, "size int, query_id long, doc_id long, rank int", second=lambda q, d_: np.round(np.einsum("ij,ij->i", q, d_), 9))
    two = two.withColumn("factor", (F.col("size") / 10).cast("int"))
    j = M.judged(two.join(base, ["query_id", "doc_id"], "left"), c.drop("vec"))
    nq = F.countDistinct("query_id")
    return j.groupBy("factor").agg(r4(F.count("base") / (10.0 * nq)).alias("agreement"), r4(F.sum(((F.col("rank") == 1) & (F.coalesce("base", F.lit(0)) == 1)).cast("int")) / nq).alias("same_top"), r4(F.avg(F.col("match").cast("double"))).alias("precision10"))


DIMS = [64, 32, 16, 8]
_DIMQ = "dims as (select unnest([64,32,16,8]) dim)"


def _cut_and_shifted(c, o):
    """id, part, vec of each order and length: one plan over all, as a union of eight takes too much of the driver."""
    each = F.array(*[F.struct(F.lit(x).alias("order"), F.lit(n).alias("dim")) for x in ("shift_first", "truncate_first") for n in DIMS])
    d = c.withColumn("p", F.explode(each)).select("id", "lang", "vec", "p.order", "p.dim")
    d = V.truncated(d, "short", "vec", F.col("dim"))
    d = d.withColumn("vec", F.when(F.col("order") == "shift_first", F.col("vec")).otherwise(F.col("short"))).drop("short")
    d = V.truncated(S.apply(d, o, 0.75, cut=True), "vec", "vec", F.col("dim"))
    return d.select("id", "vec", F.concat("order", F.col("dim").cast("string")).alias("part"))


@query(
    ctes(CORPUS, offs(), _DIMQ,
         f"a0 as (select 'shift_first' ord, dim, id, concept, lang, case when off is null then vec else list_transform(list_zip(vec, off), lambda p: p[1] - 0.75 * p[2]) end v, off is null pv, vec from corpus left join offs using (lang), dims)",
         f"a1 as (select ord, dim, id, concept, lang, (case when pv then v else {nrm('v')} end)[1:dim] v from a0)",
         f"b0 as (select 'truncate_first' ord, dim, id, concept, lang, off, vec[1:dim] v from corpus left join offs using (lang), dims)",
         f"b1 as (select ord, dim, id, concept, lang, off, {nrm('v')} v from b0)",
         "b2 as (select ord, dim, id, concept, lang, off is null pv, v w, case when off is null then v else list_transform(list_zip(v, off[1:dim]), lambda p: p[1] - 0.75 * p[2]) end v from b1)",
         f"s as (select ord || dim part, ord, dim, id, {nrm('v')} vec from a1 union all select ord || dim, ord, dim, id, {nrm('v')} from b2)",
         oknn("hits", "s", "s", 10), PER.replace("h.part,", "h.part,"))
    + ", g as (select part, avg(tgt) t, avg(hit) r from per where lang <> 'en' group by 1) select d.ord \"order\", d.dim, 4 * d.dim bytes, round(g.r, 4) recall, round(g.t, 4) tgt_hits, round(g.t / f.t, 4) retention from (select distinct part, ord, dim from s) d join g on g.part = d.part join g f on f.part = d.ord || '64'"
)
def matryoshka_sweep(spark, d):
    """Shift then cut against cut then shift: metrics, bytes and retention by length."""
    c = X.vectors(spark, d)
    parts = _cut_and_shifted(c, S.offsets(c, X.PIVOT))
    j = M.judged(knn(parts, parts, 10), c.drop("vec")).where(F.col("q_lang") != X.PIVOT)
    per = j.groupBy("part", "query_id").agg(F.max(F.col("match").cast("double")).alias("hit"), F.sum((F.col("match") & (F.col("lang") == X.PIVOT)).cast("double")).alias("tgt"))
    g = per.groupBy("part").agg(F.avg("hit").alias("r"), F.avg("tgt").alias("t")).withColumns({"order": F.regexp_extract("part", "^[a-z_]+", 0), "dim": F.regexp_extract("part", "[0-9]+$", 0).cast("int")})
    # eight rows; a join with the full length would make the lists twice
    g = g.withColumn("ft", F.max(F.when(F.col("dim") == 64, F.col("t"))).over(Window.partitionBy("order")))
    return g.select("order", "dim", (4 * F.col("dim")).alias("bytes"), r4(F.col("r")).alias("recall"), r4(F.col("t")).alias("tgt_hits"), r4(F.col("t") / F.col("ft")).alias("retention"))


# the code of a concept is a point of the ball: that of its least id
CODES = "codes as (select label code, arg_min(vec, id) vec from ball group by 1)"
DIST = f"dist as (select q.code a, d.code b, {poincare()} dd from codes q join codes d on true)"
BETAS = [0.0, 0.04, 0.08, 0.12, 0.16, 0.24, 0.40]
# concepts that stand in for combinations of substances
COMBO = "{} % 5 = 4"


def _codes(spark, d):
    p = X.ball(spark, d).groupBy(F.col("label").alias("code")).agg(F.min_by("x", "vec_id").alias("v"))
    q = p.select(F.col("code").alias("a"), F.col("v").alias("u"))
    return q.join(p.withColumnRenamed("code", "b"), F.lit(True)).select("a", "b", V.poincare("u", "v").alias("dd"))  # codes are few: a table of code pairs


def _reranked(spark, d, betas, k):
    """part (beta), query_id, doc_id, prior, score, rank of the overfetched hits; anchors: own-language nearest."""
    c = X.vectors(spark, d)
    own = knn(c.withColumn("part", F.col("lang")), c.withColumn("part", F.col("lang")), 1)
    anchor = own.join(c.select(F.col("id").alias("doc_id"), F.col("concept").alias("anchor")), "doc_id").select("query_id", "anchor")
    hits = knn(c.where(F.col("lang") != X.PIVOT), c.where(F.col("lang") == X.PIVOT), 5 * k).withColumnRenamed("rank", "prior").drop("part")
    h = hits.join(c.select(F.col("id").alias("doc_id"), "concept"), "doc_id").join(anchor, "query_id", "left")
    h = h.join(F.broadcast(_codes(spark, d)), (F.col("anchor") == F.col("a")) & (F.col("concept") == F.col("b")), "left")
    h = h.withColumn("beta", F.explode(F.array(*map(F.lit, betas))))
    h = h.withColumn("new", F.round(F.col("score") - F.coalesce(F.col("beta") * F.col("dd") / 13.0, F.lit(0.0)), 9))
    w = Window.partitionBy("beta", "query_id").orderBy(F.col("new").desc(), "prior")
    return c, anchor, h.withColumn("rank", F.row_number().over(w))


RERANK = [
    BALL, CODES, DIST, CORPUS, "o as (select *, lang part from corpus)", "qs as (select *, '' part from corpus where lang <> 'en')", "ds as (select *, '' part from corpus where lang = 'en')",
    oknn("own", "o", "o", 1), "anchor as (select query_id, concept anchor from own join corpus on id = doc_id)", oknn("hits", "qs", "ds", 50),
    f"rr as (select beta, h.query_id, h.doc_id, c.concept, h.\"rank\" prior, anchor.anchor, round(h.score - coalesce(beta * dd / 13.0, 0), 9) new, dd from hits h join corpus c on c.id = h.doc_id left join anchor on anchor.query_id = h.query_id left join dist on dist.a = anchor.anchor and dist.b = c.concept, (select unnest({BETAS})::double beta))",
    "rk as (select *, row_number() over (partition by beta, query_id order by new desc, prior) r from rr)",
]


@query(ctes(*RERANK) + "select query_id, doc_id, r::bigint \"rank\", round(new, 4) score, round(dd, 4) hyp_dist from rk where beta = 0.08::double and r <= 10")
def hyperbolic_rerank(spark, d):
    _, _, h = _reranked(spark, d, [0.08], 10)
    return h.where("rank <= 10").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(F.col("new")).alias("score"), r4(F.col("dd")).alias("hyp_dist"))


@query(
    ctes(*RERANK, "t as (select beta, query_id, max((r = 1 and rk.concept = q.concept)::int) t1, max((r <= 3 and rk.concept = q.concept)::int) t3, max((rk.anchor = q.concept)::int) ac, max((r = 1 and rk.concept <> q.concept and " + COMBO.format("rk.concept") + " and not " + COMBO.format("q.concept") + ")::int) ce from rk join corpus q on q.id = query_id group by 1, 2)")
    + "select t.beta, count(*) n, round(avg(t.t1), 4) top1, round(avg(t.t3), 4) top3, sum((b.t1 = 1 and t.t1 = 0)::int)::bigint broken, sum(t.ce)::bigint combo_err, round(avg(coalesce(t.ac, 0)), 4) anchor_accuracy from t join t b on b.query_id = t.query_id and b.beta = 0 group by 1"
)
def rerank_sweep(spark, d):
    c, _, h = _reranked(spark, d, BETAS, 10)
    q = c.select(F.col("id").alias("query_id"), F.col("concept").alias("gold"))
    hit = F.col("concept") == F.col("gold")
    t = h.join(q, "query_id").groupBy("beta", "query_id").agg(F.max(((F.col("rank") == 1) & hit).cast("int")).alias("t1"), F.max(((F.col("rank") <= 3) & hit).cast("int")).alias("t3"), F.max((F.col("anchor") == F.col("gold")).cast("int")).alias("ac"), F.max(((F.col("rank") == 1) & ~hit & F.expr(COMBO.format("concept")) & ~F.expr(COMBO.format("gold"))).cast("int")).alias("ce"))
    b = t.where("beta = 0").select("query_id", F.col("t1").alias("b1"))
    return t.join(b, "query_id").groupBy("beta").agg(F.count("*").alias("n"), r4(F.avg("t1")).alias("top1"), r4(F.avg("t3")).alias("top3"), F.sum(((F.col("b1") == 1) & (F.col("t1") == 0)).cast("long")).alias("broken"), F.sum(F.col("ce").cast("long")).alias("combo_err"), r4(F.avg(F.coalesce("ac", F.lit(0)))).alias("anchor_accuracy"))


@query(ctes(*RERANK[3:9]) + "select query_id, anchor::int anchor from anchor")
def anchor_resolution(spark, d):
    c = X.vectors(spark, d).withColumn("part", F.col("lang"))
    return knn(c, c, 1).join(c.select(F.col("id").alias("doc_id"), F.col("concept").alias("anchor")), "doc_id").select("query_id", "anchor")


FIRST = "first as (select part, query_id, min(\"rank\") r from j where match group by 1, 2)"


@query(
    ctes(CORPUS, offs(), shifted("sh", [0.0, 0.75]), "qs as (select * from sh where lang <> 'en')", "ds as (select * from sh where lang = 'en')", oknn("hits", "qs", "ds", 100), J, FIRST)
    + "select q.part::double alpha, count(*) n, round(avg((coalesce(r, 1000) <= 1)::int), 4) hit_1, round(avg((coalesce(r, 1000) <= 3)::int), 4) hit_3, round(avg((coalesce(r, 1000) <= 10)::int), 4) hit_10, round(avg(case when r <= 3 then 1.0 / r else 0 end), 4) mrr3 from qs q left join first f on f.part = q.part and f.query_id = q.id group by 1"
)
def hit_and_mrr(spark, d):
    """Target-shelf hits and the reciprocal rank cut at 3; queries whose concept is not on the shelf stay misses."""
    c = X.vectors(spark, d)
    s = S.sweep(c, S.offsets(c, X.PIVOT), [0.0, 0.75])
    q = s.where(F.col("lang") != X.PIVOT)
    j = M.judged(knn(q, s.where(F.col("lang") == X.PIVOT), 100), c.drop("vec"))
    return M.hit_at(j, q.select("part", F.col("id").alias("query_id"))).withColumn("alpha", F.col("part").cast("double")).drop("part")


@query(
    ctes(CORPUS, "s as (select *, '' part from corpus)", oknn("hits", "s", "s", 10), J, "p as (select q_lang, query_id, avg((lang = q_lang)::int) same from j group by 1, 2)", "sh as (select lang, count(*) / (select count(*) from corpus)::double share from corpus group by 1)")
    + "select lang, count(*) n, round(avg(same), 4) same_share, round(any_value(share), 4) corpus_share, round(avg(same) / any_value(share), 4) lift, avg(same) / any_value(share) > 1.5 flagged from p join sh on sh.lang = p.q_lang group by 1 "
    + "union all select 'all', count(*), round(avg(same), 4), round(avg(share), 4), round(avg(same) / avg(share), 4), avg(same) / avg(share) > 1.5 from p join sh on sh.lang = p.q_lang"
)
def language_lift(spark, d):
    c = X.vectors(spark, d)
    j = M.judged(knn(c, c, 10), c.drop("vec"))
    p = j.groupBy("q_lang", "query_id").agg(F.avg((F.col("lang") == F.col("q_lang")).cast("double")).alias("same"))
    sh = c.groupBy("lang").agg(F.count("*").alias("m")).withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy()))  # a row a language
    each = p.withColumnRenamed("q_lang", "lang").join(F.broadcast(sh.select("lang", "share")), "lang")
    about = [F.count("*").alias("n"), F.avg("same").alias("s"), F.avg("share").alias("share")]
    g = each.groupBy("lang").agg(*about).union(each.agg(F.lit("all").alias("lang"), *about))  # all: weighted by queries
    return g.select("lang", "n", r4(F.col("s")).alias("same_share"), r4(F.col("share")).alias("corpus_share"), r4(F.col("s") / F.col("share")).alias("lift"), (F.col("s") / F.col("share") > 1.5).alias("flagged"))


@query(ctes(CORPUS, offs(), shifted("s", ALPHAS), oknn("hits", "s", "s", 10), PER) + "select alpha best_alpha, round(t, 4) tgt_hits from (select part::double alpha, avg(x) t from (select part, lang, avg(tgt) x from per where lang <> 'en' group by 1, 2) group by 1) order by round(t, 9) desc, alpha limit 1")
def best_alpha(spark, d):
    c, h = _sweep_hits(spark, d)
    j = M.judged(h, c.drop("vec")).where(F.col("q_lang") != X.PIVOT)
    per = j.groupBy("part", "q_lang", "query_id").agg(F.sum((F.col("match") & (F.col("lang") == X.PIVOT)).cast("double")).alias("tgt")).groupBy("part", "q_lang").agg(F.avg("tgt").alias("x"))
    m = per.groupBy(F.col("part").cast("double").alias("alpha")).agg(F.avg("x").alias("t"))
    return m.orderBy(F.round("t", 9).desc(), "alpha").limit(1).select(F.col("alpha").alias("best_alpha"), r4(F.col("t")).alias("tgt_hits"))


TGT = "t as (select query_id, q_concept, part, sum((match and lang = 'en')::int) g from j group by 1, 2, 3)"


@query(
    ctes(CORPUS, offs(), shifted("s", [0.0, 0.75]), oknn("hits", "s", "s", 10), J, TGT, "g as (select a.query_id, a.q_concept concept, b.g - a.g gain, b.g correct from t a join t b using (query_id) where a.part = '0.0' and b.part = '0.75')")
    + "select query_id, concept, gain::bigint gain, correct::bigint correct, row_number() over (partition by concept order by gain desc, correct desc, query_id)::bigint \"rank\" from g qualify \"rank\" = 1"
)
def demo_queries(spark, d):
    """The query of each concept that the shift helps most."""
    c, h = _sweep_hits(spark, d, 10, [0.0, 0.75])
    t = M.judged(h, c.drop("vec")).groupBy("query_id", F.col("q_concept").alias("concept")).agg(*[F.sum((F.col("match") & (F.col("lang") == X.PIVOT) & (F.col("part") == p)).cast("long")).alias(n) for p, n in (("0.0", "off"), ("0.75", "on"))])
    t = t.withColumns({"gain": F.col("on") - F.col("off")})
    w = Window.partitionBy("concept").orderBy(F.col("gain").desc(), F.col("on").desc(), "query_id")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where("rank = 1").select("query_id", "concept", "gain", F.col("on").alias("correct"), "rank")


@query(
    ctes(CORPUS, offs(), shifted("s", [0.0, 0.75]), oknn("hits", "s", "s", 10), J)
    + "select query_id, part::double alpha, sum((lang = q_lang)::int)::bigint same_language, round(avg((lang = q_lang)::int), 3) share, count(distinct lang) distinct_languages, sum(match::int)::bigint matches, round(sum((lang = 'en')::int) / greatest(count(*), 1)::double, 3) tgt_share, arg_min(concept, \"rank\") top_concept, sum((concept = q_concept and \"rank\" = 1)::int)::bigint top_match from j group by 1, 2"
)
def off_on_compare(spark, d):
    """Both answers of every query, without and with the shift, summed up."""
    c, h = _sweep_hits(spark, d, 10, [0.0, 0.75])
    j = M.judged(h, c.drop("vec"))
    own = F.col("lang") == F.col("q_lang")
    return j.groupBy("query_id", F.col("part").cast("double").alias("alpha")).agg(
        F.sum(own.cast("long")).alias("same_language"), F.round(F.avg(own.cast("double")), 3).alias("share"), F.countDistinct("lang").alias("distinct_languages"), F.sum(F.col("match").cast("long")).alias("matches"),
        F.round(F.avg((F.col("lang") == X.PIVOT).cast("double")), 3).alias("tgt_share"), F.min_by("concept", "rank").alias("top_concept"), F.sum((F.col("match") & (F.col("rank") == 1)).cast("long")).alias("top_match"),
    )


@query(
    ctes(CORPUS, "s as (select *, '' part from corpus)", oknn("hits", "s", "s", 8), J, "l as (select distinct lang from corpus)", "q as (select distinct query_id from j)")
    + "select q.query_id, l.lang, count(j.doc_id) n, row_number() over (partition by q.query_id order by count(j.doc_id) desc, l.lang)::bigint lane from q cross join l left join j on j.query_id = q.query_id and j.lang = l.lang group by 1, 2"
)
def language_lanes(spark, d):
    """Hits of each query by language, languages without hits included."""
    c = X.vectors(spark, d)
    j = M.judged(knn(c, c, 8), c.drop("vec"))
    langs = F.broadcast(c.select("lang").distinct())  # a row a language
    g = c.select(F.col("id").alias("query_id")).crossJoin(langs).join(j.groupBy("query_id", "lang").agg(F.count("*").alias("n")), ["query_id", "lang"], "left").fillna(0, ["n"])
    return g.withColumn("lane", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "lang")).cast("long"))


@query(ctes(CORPUS, "s as (select *, '' part from corpus)", oknn("hits", "s", "s", 8), J) + "select query_id, arg_min(concept, \"rank\") lead, sum((concept = f)::int)::bigint shared from (select *, first_value(concept) over (partition by query_id order by \"rank\") f from j) group by 1")
def hub_match(spark, d):
    """The leading concept of the eight best and how many of them share it."""
    c = X.vectors(spark, d)
    j = M.judged(knn(c, c, 8), c.drop("vec"))
    lead = F.first("concept").over(Window.partitionBy("query_id").orderBy("rank"))
    return j.withColumn("f", lead).groupBy("query_id").agg(F.min_by("concept", "rank").alias("lead"), F.sum((F.col("concept") == F.col("f")).cast("long")).alias("shared"))


@query(
    ctes(CORPUS, "s as (select *, '' part from corpus)", "a as (select query_id, lang, avg(score) m from (select h.*, c.lang, row_number() over (partition by query_id, c.lang order by score desc, doc_id) r from (select q.id query_id, d.id doc_id, round(list_inner_product(q.vec, d.vec), 9) score from corpus q join corpus d on q.id <> d.id) h join corpus c on c.id = h.doc_id qualify r <= 5) group by 1, 2)",
         "b as (select query_id, lang pred from a qualify row_number() over (partition by query_id order by round(m, 9) desc, lang) = 1)")
    + "select c.lang, count(*) n, round(avg((pred = c.lang)::int), 4) accuracy from b join corpus c on c.id = b.query_id group by 1"
)
def embedding_langid(spark, d):
    """Language by the mean of the five best cosines of each language."""
    c = X.vectors(spark, d)
    langs = [r.lang for r in c.select("lang").distinct().collect()]  # a handful
    q = c.select("id", "vec").withColumn("part", F.explode(F.array(*map(F.lit, langs))))
    m = knn(q, c.withColumn("part", F.col("lang")), 5).groupBy("query_id", "part").agg(F.round(F.avg("score"), 9).alias("m"))
    best = m.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("m").desc(), "part"))).where("r = 1")
    return best.join(c.select(F.col("id").alias("query_id"), "lang"), "query_id").groupBy("lang").agg(F.count("*").alias("n"), r4(F.avg((F.col("part") == F.col("lang")).cast("double"))).alias("accuracy"))


@query(
    ctes(CORPUS, "s as (select *, '' part from corpus)", oknn("a", "s", "s", 10), oknn("b", "s", "s", 10, f"-sqrt({SQD})"), oknn("c", "s", "s", 10, f"-acos(greatest(-1.0, least(1.0, {DOT})))"))
    + "select 'euclid' metric, round(avg((a.doc_id = b.doc_id)::int), 3) same_place from a join b using (query_id, \"rank\") union all select 'angular', round(avg((a.doc_id = c.doc_id)::int), 3) from a join c using (query_id, \"rank\")"
)
def metric_invariance(spark, d):
    """On unit vectors cosine, Euclidean and angular order agree: share of equal places."""
    c = X.vectors(spark, d)
    a = knn(c, c, 10).select("query_id", "rank", F.col("doc_id").alias("a"))
    e = knn(c, c, 10, "euclid").select("query_id", "rank", F.col("doc_id").alias("b"), F.lit("euclid").alias("metric"))
    g = knn(c, c, 10, "angular").select("query_id", "rank", F.col("doc_id").alias("b"), F.lit("angular").alias("metric"))
    return e.union(g).join(a, ["query_id", "rank"]).groupBy("metric").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 3).alias("same_place"))


@query(
    ctes(CORPUS, offs(), shifted("f", [0.75]),
         "gz as (select id, concept, lang, vec, off is null nooff, coalesce(off, list_transform(vec, lambda x: 0.0::double)) off from corpus left join offs using (lang))",
         "g0 as (select *, list_inner_product(vec, off) vo from gz)",
         "g1 as (select *, list_transform(list_zip(off, vec), lambda p: -p[1] + vo * p[2]) t from g0)",
         "g2 as (select *, greatest(sqrt(list_inner_product(t, t)), 1e-12) tn from g1)",
         "g as (select id, concept, lang, case when nooff then vec else list_transform(list_zip(vec, t), lambda p: cos(0.75 * tn) * p[1] + sin(0.75 * tn) * p[2] / tn) end vec from g2)")
    + "select g.lang, count(*) n, round(avg(sqrt(list_sum(list_transform(list_zip(g.vec, f.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 4) displacement, round(avg(sqrt(list_inner_product(g.vec, g.vec))), 4) norm from g join f on f.id = g.id group by 1"
)
def flat_vs_geodesic(spark, d):
    """The flat shift against the one along the sphere: mean displacement by language."""
    c = X.vectors(spark, d)
    o = S.offsets(c, X.PIVOT)
    flat = S.apply(c, o, 0.75).select("id", F.col("vec").alias("f"))
    g = V.geodesic_shift(c.join(F.broadcast(o), "lang", "left"), "g", "vec", "off", 0.75).withColumn("g", F.coalesce("g", "vec"))
    return g.join(flat, "id").groupBy("lang").agg(F.count("*").alias("n"), r4(F.avg(V.euclid("g", "f"))).alias("displacement"), r4(F.avg(V.norm("g"))).alias("norm"))


@query(
    ctes(CORPUS, offs("o1", cond="true"), "fit as (select *, list_concat(vec[2:64], vec[1:1]) qv from corpus)", offs("o2", "fit", "qv"))
    + "select a.lang, round(list_inner_product(a.off, list_concat(b.off[64:64], b.off[1:63])) / (sqrt(list_inner_product(a.off, a.off)) * sqrt(list_inner_product(b.off, b.off))), 4) agreement, round(sqrt(list_inner_product(a.off, a.off)), 4) doc_norm, round(sqrt(list_inner_product(b.off, b.off)), 4) query_norm from o1 a join o2 b using (lang)"
)
def two_space_offsets(spark, d):
    """Offsets of the document space and of the query space (the rotated vector), compared."""
    c = X.vectors(spark, d)
    a = S.offsets(c, X.PIVOT)
    b = S.offsets(c.withColumn("qv", X.rotated()), X.PIVOT, "qv").select("lang", F.col("off").alias("q"))
    j = a.join(b, "lang").withColumn("back", F.concat(F.slice("q", 64, 1), F.slice("q", 1, 63)))
    return j.select("lang", r4(V.dot("off", "back") / (V.norm("off") * V.norm("q"))).alias("agreement"), r4(V.norm("off")).alias("doc_norm"), r4(V.norm("q")).alias("query_norm"))


HALF = "(id * 7919) % 1000003 % 2"


@query(
    ctes(CORPUS, *[f"h{i} as (select * from corpus where {HALF} = {i})" for i in (0, 1)], offs("a", "h0"), offs("b", "h1"))
    + "select lang, round(list_inner_product(a.off, b.off) / (sqrt(list_inner_product(a.off, a.off)) * sqrt(list_inner_product(b.off, b.off))), 4) agreement from a join b using (lang)"
)
def split_half(spark, d):
    """Cosine of offsets from two disjoint halves (an arithmetic hash of the id splits)."""
    c = X.vectors(spark, d).withColumn("half", (F.col("id") * 7919) % 1000003 % 2)
    a, b = (S.offsets(c.where(F.col("half") == i), X.PIVOT).select("lang", F.col("off").alias(n)) for i, n in ((0, "a"), (1, "b")))
    return a.join(b, "lang").select("lang", r4(V.dot("a", "b") / (V.norm("a") * V.norm("b"))).alias("agreement"))


@query(
    ctes(CORPUS, offs("od"), "qc as (select *, list_concat(vec[2:64], vec[1:1]) qv from corpus)", offs("oq", "qc", "qv"),
         "back as (select lang, list_concat(off[64:64], off[1:63]) off from oq)",
         shifted("plain", [0.0]), shifted("dv", [0.75], off="od"), shifted("bq", [0.75], off="back"),
         "qs as (select 'plain' part, id, vec from plain union all select 'both', id, vec from dv union all select 'query_only', id, vec from bq)",
         "ds as (select 'plain' part, id, vec from plain union all select 'both', id, vec from dv union all select 'query_only', id, vec from plain)",
         oknn("hits", "qs", "ds", 10), PER).replace("offs o on", "od o on", 1)
    + "select part config, count(*) n, round(avg(hit), 4) recall, round(avg(tgt), 4) tgt_hits from per group by 1"
)
def prefix_configurations(spark, d):
    """Which side of the search is corrected, and from which space's offsets."""
    c = X.vectors(spark, d)
    od = S.offsets(c, X.PIVOT)
    oq = S.offsets(c.withColumn("qv", X.rotated()), X.PIVOT, "qv").select("lang", F.concat(F.slice("off", 64, 1), F.slice("off", 1, 63)).alias("off"))
    both, query_side = S.apply(c, od, 0.75), S.apply(c, oq, 0.75)

    def tag(x, p):
        return x.select("id", "vec", F.lit(p).alias("part"))

    q = tag(c, "plain").union(tag(both, "both")).union(tag(query_side, "query_only"))
    t = tag(c, "plain").union(tag(both, "both")).union(tag(c, "query_only"))
    per = M.judged(knn(q, t, 10), c.drop("vec")).groupBy("part", "query_id").agg(F.max(F.col("match").cast("double")).alias("hit"), F.sum((F.col("match") & (F.col("lang") == X.PIVOT)).cast("double")).alias("tgt"))
    return per.groupBy(F.col("part").alias("config")).agg(F.count("*").alias("n"), r4(F.avg("hit")).alias("recall"), r4(F.avg("tgt")).alias("tgt_hits"))


@query(
    "with m as (select vec_id, label, unnest(range(0, 8)) g, list_transform(embedding, lambda x: x::double) v from embeddings), t as (select vec_id, label, g, v[(g * 8 + 1)::int:(g * 8 + 8)::int] x from m), "
    "s as (select q.vec_id query_id, d.vec_id doc_id, q.g, max(list_inner_product(q.x, d.x)) b from t q join t d on q.vec_id <> d.vec_id and q.label = d.label group by 1, 2, 3), z as (select query_id, doc_id, round(sum(b), 9) score from s group by 1, 2), "
    "n as (select *, row_number() over (partition by query_id order by score desc, doc_id) r, min(score) over (partition by query_id) lo, max(score) over (partition by query_id) hi from z) "
    "select query_id, doc_id, r::bigint \"rank\", round(score, 4) score, round((score - lo) / greatest(hi - lo, 1e-9), 4) + 0.0 minmax from n where r <= 5"
)
def maxsim(spark, d):
    """Late interaction: the sum over query tokens of the best document token, and its min-max form, inside the query's class."""
    e = _multivectors(spark, d).withColumn("part", F.col("label").cast("string"))
    best, worst = knn(e, e, 5, "maxsim:8"), knn(e, e, 1, "-maxsim:8").select("query_id", (-F.col("score")).alias("lo"))
    return _minmax(best.join(worst, "query_id"))


def _multivectors(spark, d):
    """id, label, vec: eight tokens of eight numbers, one after the other."""
    return X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def _minmax(hits):
    """hits with lo, the query's lowest score; rank 1 has the highest."""
    hi = F.max("score").over(Window.partitionBy("query_id"))
    form = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    return hits.withColumn("hi", hi).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(F.col("score")).alias("score"), r4(form).alias("minmax"))


PREFETCH = 50


@query()
def maxsim_prefetch(spark, d):
    """Late interaction over the dense prefetch list of all documents, whatever their label, and its min-max form in that list; no SQL."""
    e = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    pairs = knn(e, e, PREFETCH).select("query_id", "doc_id")
    t = e.select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("g"), "vec").select("id", "g", F.slice("vec", F.col("g") * 8 + 1, F.lit(8)).alias("x"))
    s = pairs.join(t.select(F.col("id").alias("query_id"), "g", F.col("x").alias("qx")), "query_id").join(t.select(F.col("id").alias("doc_id"), F.col("x").alias("dx")), "doc_id")
    z = s.groupBy("query_id", "doc_id", "g").agg(F.max(V.dot("qx", "dx")).alias("b")).groupBy("query_id", "doc_id").agg(F.round(F.sum("b"), 9).alias("score"))
    w = Window.partitionBy("query_id")
    n = ranked(z.withColumns({"lo": F.min("score").over(w), "hi": F.max("score").over(w)}), 5, ("query_id",))
    return n.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), r4(F.col("score")).alias("score"), r4((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))).alias("minmax"))
