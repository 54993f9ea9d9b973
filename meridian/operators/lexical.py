"""Lexical language identification, BM25, sparse dot products and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MARGIN = 0.2
K1, B = 1.2, 0.75
RRF_K = 60
#: Numbers of a table of tokens' shares up to which it is broadcast (about 60 bytes a token besides).
BROADCAST_SHARES = 2_000_000


def document_frequency(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, token, df) and (lang, n)."""
    df = docs.select("lang", F.explode(T.tokens("text")).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("df"))
    return df, docs.groupBy("lang").agg(F.count("*").alias("n"))


def identify(texts: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """id, lang, margin, coverage, confident: the mean share of the known tokens' rates.

    A token is one row with its shares of all languages.  That table is broadcast if a count shows it to be
    small, so the texts' tokens aren't shuffled at all; beyond that the join is plain, and Spark's skew
    handling splits frequent tokens.
    """
    langs = sorted(r.lang for r in n.select("lang").collect() if r.lang is not None)  # a row a language
    rate = df.join(F.broadcast(n), "lang").withColumn("rate", F.col("df") / F.col("n"))
    names = [f"s{i}" for i in range(len(langs))]
    wide = rate.groupBy("token").agg(F.sum("rate").alias("all"), *[F.sum(F.when(F.col("lang") == x, F.col("rate")).otherwise(0.0)).alias(c) for c, x in zip(names, langs, strict=True)])
    wide = wide.select("token", F.lit(1).alias("one"), *[(F.col(c) / F.col("all")).alias(c) for c in names]).persist()
    small = wide.count() * max(len(langs), 1) <= BROADCAST_SHARES
    toks = texts.select("id", T.tokens("text").alias("t")).select("id", F.size("t").alias("n_toks"), F.explode_outer("t").alias("token"))
    hit = toks.join(F.broadcast(wide) if small else wide, "token", "left")
    per = hit.groupBy("id").agg(F.max("n_toks").alias("n_toks"), F.count("one").alias("known"), *[F.sum(c).alias(c) for c in names])
    best = F.array_sort(F.array(*[F.struct((-F.round(F.col(c) / F.col("known"), 9)).alias("s"), F.lit(x).alias("lang")) for c, x in zip(names, langs, strict=True)])) if langs else F.array().cast("array<struct<s:double,lang:string>>")
    per = per.withColumn("best", F.when(F.col("known") > 0, best))
    margin = -F.get("best", F.lit(0))["s"] + F.coalesce(F.get("best", F.lit(1))["s"], F.lit(0.0))
    out = per.withColumn("margin", margin).select("id", F.get("best", F.lit(0))["lang"].alias("lang"), "margin", "known", "n_toks")
    return out.select("id", "lang", F.coalesce("margin", F.lit(0.0)).alias("margin"), (F.col("known") / F.greatest("n_toks", F.lit(1))).alias("coverage"), F.coalesce(F.round("margin", 9) >= MARGIN, F.lit(False)).alias("confident"))


def chosen_language(override: str, lang: str, confident: str, pivot: str) -> Column:
    """A given language, else a confidently detected one, else the pivot."""
    return F.coalesce(F.nullif(F.col(override), F.lit("")), F.when(F.col(confident), F.col(lang)), F.lit(pivot))


def evidence(texts: DataFrame, df: DataFrame, n: DataFrame, top: int = 6) -> DataFrame:
    """id, rank, token, lang, share: the tokens that decided."""
    rate = df.join(F.broadcast(n), "lang").withColumn("rate", F.col("df") / F.col("n"))
    share = rate.withColumn("share", F.round(F.col("rate") / F.sum("rate").over(Window.partitionBy("token")), 9))
    best = share.groupBy("token").agg(F.min(F.struct((-F.col("share")).alias("s"), "lang")).alias("b")).select("token", F.col("b.lang").alias("lang"), (-F.col("b.s")).alias("share"))
    hit = texts.select("id", F.explode(T.tokens("text")).alias("token")).join(best, "token")
    w = Window.partitionBy("id").orderBy(F.col("share").desc(), "token")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def words(text: str) -> Column:
    """The lower-case words of three letters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}{3,}"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """id, term, tf, len."""
    t = docs.select("id", words("text").alias("t"))
    t = t.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return t.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25_weights(post: DataFrame, docs: DataFrame) -> DataFrame:
    """id, term, w: Okapi BM25 weights of the documents' terms."""
    stats = docs.agg(F.count("*").alias("nd"))
    avg = post.select("id", "len").distinct().agg(F.sum("len").alias("total"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    p = post.join(df, "term").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(avg))  # one row each
    idf = F.ln(1 + (F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return p.select("id", "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("nd"))))).alias("w"))


def sparse_topk(queries: DataFrame, weights: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """query_id, doc_id, score, rank; queries: id, term, w.  No shared term: no row."""
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    h = q.join(weights.select(F.col("id").alias("doc_id"), "term", "w"), "term")
    if skip_self:
        h = h.where("query_id <> doc_id")
    s = h.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 7).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, doc_id, score, rank of ranked lists fused by reciprocal ranks."""
    all_ = None
    for x in lists:
        x = x.select("query_id", "doc_id", (F.lit(1.0) / (k + F.col("rank"))).alias("r"))
        all_ = x if all_ is None else all_.union(x)
    s = all_.groupBy("query_id", "doc_id").agg(F.round(F.sum("r"), 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rank", F.row_number().over(w))
