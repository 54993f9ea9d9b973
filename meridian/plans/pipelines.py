"""Training, half precision, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vec as V
from ..operators import metrics as M
from ..operators import training
from ..operators.knn import knn
from ..sources import fixtures as X
from ..sources import readers as R
from ..streaming import scan as S
from .oracle import CORPUS, blocks, ctes, knn as oknn, query

r4 = M.r4


def _pairs(spark, d):
    t = X.tree(spark, d)
    codes = t.select("code").distinct()
    ids = {r.code: i for i, r in enumerate(codes.orderBy("code").collect())}  # a code tree is small by nature
    number = spark.createDataFrame(list(ids.items()), "code string, n long")
    p = t.select(F.col("code").alias("c"), F.explode(F.slice(T.ancestors("code"), 1, F.size(T.ancestors("code")) - 1)).alias("a"))
    return p.join(F.broadcast(number.withColumnsRenamed({"code": "c", "n": "child"})), "c").join(F.broadcast(number.withColumnsRenamed({"code": "a", "n": "ancestor"})), "a")


DIMS, EPOCHS = [2, 5, 10, 20, 50], 300


@query()
def poincare_training(spark, d):
    """A grid of trained embeddings (2 to 50 numbers, 300 epochs): mean average precision of ancestors and the largest norm."""
    p = _pairs(spark, d).select("child", "ancestor").persist()
    e = training.grid(p, DIMS, ["poincare", "euclidean"], epochs=EPOCHS).withColumn("part", F.concat("geometry", F.lit("-"), F.col("dim").cast("string"))).persist()
    truth = p.select(F.col("child").alias("query_id"), F.col("ancestor").alias("doc_id"), F.lit(True).alias("hit"))
    out = None
    for g, metric in (("poincare", "poincare"), ("euclidean", "euclid")):
        v = e.where(F.col("geometry") == g).select("part", F.col("node").alias("id"), F.col("x").alias("vec"))
        order = knn(v, v, 10**6, metric).join(truth, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        for dim in DIMS:
            name = f"{g}-{dim}"
            ap = M.average_precision(order.where(F.col("part") == name)).agg(F.count("*").alias("n"), r4(F.avg("ap")).alias("map"))
            row = ap.crossJoin(v.where(F.col("part") == name).agg(r4(F.max(V.norm("vec"))).alias("max_norm"))).withColumn("config", F.lit(name))
            out = row if out is None else out.union(row)
    return out


#: A number to the nearest 16-bit float, ties to even: 11 binary digits, 2 ** -24 at least.
HALF = "case when x = 0 then 0.0::double else round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) end"


@query(
    ctes(
        CORPUS, f"p as (select id, pos, x, {HALF} h from (select id, unnest(vec) x, generate_subscripts(vec, 1) pos from corpus))",
        "w as (select id, '' part, list(x order by pos) x, list(h order by pos) h, max(abs(x - h)) drift from p group by id)",
        "sa as (select id, part, x vec from w)", "sb as (select id, part, h vec from w)", oknn("ha", "sa", "sa", 10), oknn("hb", "sb", "sb", 10),
        "j as (select query_id, len(list_intersect(list(ha.doc_id), list(hb.doc_id))) / 10.0::double o, bool_and(ha.doc_id = hb.doc_id) same from ha join hb using (query_id, \"rank\") group by 1)",
    )
    + "select count(*) n, round(avg(o), 4) overlap, round(avg(same::int), 4) same_order, (select max(drift) < 0.001 from w) drift_small, (select max(2 * len(h)) from w) \"bytes\" from j"
)
def half_precision(spark, d):
    """What a 16-bit export changes: the same ten neighbours, the same order, the largest drift."""
    c = X.vectors(spark, d).select("id", "vec")
    h = R.half(c)
    back = R.unhalf(h)
    a, b = knn(c, c, 10).select("query_id", "rank", F.col("doc_id").alias("a")), knn(back, back, 10).select("query_id", "rank", F.col("doc_id").alias("b"))
    j = a.join(b, ["query_id", "rank"]).groupBy("query_id").agg((F.size(F.array_intersect(F.collect_list("a"), F.collect_list("b"))) / 10.0).alias("o"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    out = j.agg(F.count("*").alias("n"), r4(F.avg("o")).alias("overlap"), r4(F.avg(F.col("same").cast("double"))).alias("same_order"))
    return out.crossJoin(F.broadcast(h.agg((F.max("drift") < 0.001).alias("drift_small"), F.max(F.octet_length("bytes")).alias("bytes"))))


@query(ctes(blocks(), "g as (select *, lower(trim(\"text\")) k, round(confidence * area, 9) s from blocks where confidence >= 0.30::double)") + "select scan_id, k \"key\", frame, pos, count(*) over (partition by scan_id, k) seen from g qualify row_number() over (partition by scan_id, k order by s desc, frame, pos) = 1")
def streaming_best_readings(spark, d):
    """Best readings over a stream of frames; equal to the batch result."""
    raw = spark.readStream.schema(X.read(spark, d, "conversations").schema).parquet(f"{d}/conversations*.parquet")
    return S.drained(S.best_readings(X.text_blocks(raw)), "complete", "meridian_best_readings").select("scan_id", "key", "frame", "pos", "seen")


@query("select lower(w) brand, role registry, count(*) times from (select role, unnest(string_split(replace(\"text\", chr(10), ' '), ' ')) w from conversations) where w <> '' group by 1, 2")
def streaming_scan_memory(spark, d):
    """Distinct products (here: words) by how often they were scanned."""
    raw = spark.readStream.schema(X.read(spark, d, "conversations").schema).parquet(f"{d}/conversations*.parquet")
    s = raw.select(F.explode(F.split(F.lower("text"), "[\n ]")).alias("brand"), F.col("role").alias("registry")).where("brand <> ''")
    return S.drained(S.scan_memory(s), "complete", "meridian_scan_memory")


@query("select time_bucket(interval '1 hour', ts) \"start\", event_type, count(*) n from events group by 1, 2")
def streaming_windows(spark, d):
    """Hourly event counts of a stream."""
    raw = spark.readStream.schema(X.read(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    return S.drained(S.windowed_counts(raw), "complete", "meridian_event_windows")
