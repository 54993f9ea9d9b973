"""URL filter: host and path rules, else a character language-model ratio [DataFrame functions only].

Two smoothed variable-order Markov models (Witten-Bell interpolation of orders 3 to 0 and a uniform
floor) are counted from the URLs that rules accept and reject, four fifths of the distinct ones by a hash.
A URL without a rule is judged by its log-likelihood ratio a character, against a threshold calibrated on
the other fifth, which the models haven't seen: the point between both classes' means that lies as many of
their standard deviations from either.  Where that fifth lacks a class, all URLs with rules calibrate.

Null URLs and URLs without ``://`` have empty host and path and are judged by the model of an empty
string.  If one class has no URL, every URL without a rule is allowed.  Repeated rows get equal
verdicts.  Null ids and columns of any name are allowed; an empty table gives an empty table.  A URL of any
length is used whole.

Equal URLs are judged once, so a URL that a third of all pages share is one row of the model; bringing
verdicts back and, beyond BROADCAST_ROWS, looking grams up are plain joins of written tables, which Spark's
skew handling splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Longest context, and characters that a model knows (letters, 0 for digits, 8 signs, start, end).
ORDER = 3
ALPHABET = 37
RULES: list[tuple[str, str, str]] = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: One in so many distinct URLs with a rule calibrates the threshold instead of being counted.
FOLDS = 5
#: A table of n-gram scores is broadcast only up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def matched(rules: list[tuple[str, str, str]], host: Column, path: Column, what) -> Column:
    """The longest rule that fits; what(rule) says which column is wanted."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(what(h, p, verdict))) if out is None else out.when(fits, F.lit(what(h, p, verdict)))
    return F.lit(None).cast("string") if out is None else out


def normal(host: Column, path: Column) -> Column:
    """Start marks, the URL in the models' alphabet, an end mark."""
    s = F.regexp_replace(F.translate(F.concat(host, path), _UPPER, _LOWER), "[0-9]", "0")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(s, "[^a-z0./_~%:-]", "?"), F.lit("$"))


def _grams(s: Column) -> Column:
    """All runs of ORDER + 1 characters, in one pass (taking substrings by place would be quadratic)."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def gram_scores(grams: DataFrame) -> DataFrame:
    """gram, ratio: log of accepted over rejected probability of the gram's last character.

    grams: gram, a, r (how often accepted and rejected URLs have it), one row a gram.
    """
    seen = {ORDER + 1: grams.select(F.col("gram").alias("g"), "a", "r")}
    for k in range(ORDER, 0, -1):  # counts of shorter grams are sums of the longer ones'
        seen[k] = seen[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    lower: DataFrame | None = None
    for k in range(1, ORDER + 2):
        w = Window.partitionBy(F.substring("g", 1, k - 1))  # a context: at most ALPHABET rows
        level = seen[k].withColumns({f"{x}{c}": f for c in "ar" for x, f in (("n", F.sum(c).over(w)), ("t", F.sum((F.col(c) > 0).cast("int")).over(w)))})
        if lower is not None:
            level = level.withColumn("tail", F.substring("g", 2, k - 1)).join(lower, "tail")
        p = {c: F.col(f"p{c}") if k > 1 else F.lit(1.0 / ALPHABET) for c in "ar"}
        now = [F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * p[c]) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(p[c]).alias(f"p{c}") for c in "ar"]
        lower = level.select(F.col("g").alias("tail"), *now)
    return lower.select(F.col("tail").alias("gram"), (F.ln("pa") - F.ln("pr")).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log ratio a character), threshold."""
    host, path = host_path(F.col("_url"))
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    d = d.withColumns({"rule": matched(rules, h, p, lambda a, b, v: a + b), "ruled": matched(rules, h, p, lambda a, b, v: v)})
    # equal URLs are judged once
    d = d.withColumn("s", normal(h, p)).withColumn("u", F.md5("s"))  # a URL's name: its n-grams don't carry the URL
    urls = d.groupBy("u").agg(F.first("s").alias("s"), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("r"))
    urls = materialize(urls.withColumn("back", F.conv(F.substring("u", 1, 4), 16, 10).cast("int") % FOLDS == 0), "urls")
    exploded = urls.select("u", "a", "r", "back", F.explode(_grams(F.col("s"))).alias("gram"))
    counted = exploded.groupBy("gram").agg(*[F.sum(F.when(F.col("back"), 0).otherwise(F.col(c))).alias(c) for c in "ar"])
    scores = materialize(gram_scores(counted), "gram-scores")
    if scores.count() <= BROADCAST_ROWS:
        scores = F.broadcast(scores)
    rated = exploded.join(scores, "gram").groupBy("u", "a", "r", "back").agg((F.sum("ratio") / F.count("*")).alias("score")).withColumn("score", F.round("score", 9))
    rated = materialize(rated, "url-scores")

    def cut(rows: Column) -> Column:
        def moments(n: str) -> tuple[Column, Column]:
            w = F.when(rows, F.col(n)).otherwise(0)
            mean = F.sum(w * F.col("score")) / F.sum(w)
            return mean, F.sqrt(F.greatest(F.sum(w * F.col("score") * F.col("score")) / F.sum(w) - mean * mean, F.lit(0.0)))

        (ma, sa), (mr, sr) = moments("a"), moments("r")
        return F.when(sa + sr > 0, (ma * sr + mr * sa) / (sa + sr)).otherwise((ma + mr) / 2)

    there = {x: F.max(F.when(F.col(x) > 0, F.col("back"))) for x in "ar"}  # null: no URL of the class; true: some held back
    some, every = there["a"].isNotNull() & there["r"].isNotNull(), there["a"] & there["r"]
    threshold = rated.agg(F.round(F.when(some, F.when(every, cut(F.col("back"))).otherwise(cut(F.lit(True)))), 9).alias("threshold"))  # one row
    verdict = F.when(F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")), F.lit("allow")).otherwise(F.lit("block"))
    out = d.drop("s").join(rated.select("u", "score"), "u").crossJoin(F.broadcast(threshold))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), "score", "threshold")
