"""Quality rules as a bitmask ledger [DataFrame functions only].

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit for
each rule.  A policy is a version and the mask of the rules it enforces; applying one is a bitwise
AND, and ablations (what a policy without one rule would keep) are sums over the distinct bit
patterns, of which there are at most 2 ** number of rules.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null text: no words (fails ``few_words``).  Repeated rows are each
judged alike; an empty table gives an empty ledger; other columns are kept out of the ledger.  Windows
of five words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\f\r"

#: name, failure as a function of the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: version: the rules it enforces
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every row; no shuffle."""
    t = F.col("_text")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    trimmed = F.btrim(t, F.lit(_BLANK))
    d = d.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""))
    w = F.col("_w")
    d = d.withColumn("_h", F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])))
    h = F.col("_h")
    # most texts repeat no window; only the others are sorted
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("_s")
    again = F.filter(s, lambda z, k: ((k > 0) & (F.get(s, k - 1)["x"] == z["x"])) | F.coalesce(F.get(s, k + 1)["x"] == z["x"], F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda z: z["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, k - 1), F.lit(-WINDOW)))), F.lit(0), lambda a, x: a + x)
    chars = F.length(t)
    # one row in, one row out: the generator keeps filters on the measurements above them, where pushing
    # a filter down would write every expression into the next one again and again
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        _without(t, _BLANK).cast("long").alias("word_chars"),
        (chars - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(p.isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    return d.select("doc_id", F.inline(F.array(measures)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and fail_bits."""
    bits = sum((F.when(F.expr(failure), F.lit(BIT[name])).otherwise(F.lit(0)) for name, failure in RULES), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("int"))


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """Adds kept: no rule that the policy enforces has failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def patterns(led: DataFrame) -> DataFrame:
    """fail_bits, n: at most 2 ** number of rules rows (pre-aggregated before the shuffle)."""
    return led.groupBy("fail_bits").agg(F.count("*").alias("n"))


def ablations(led: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, that only it rejects, and that the policy keeps without it."""
    spark, mask = led.sparkSession, POLICIES[version]
    rules = spark.createDataFrame([(n, b) for n, b in BIT.items() if b & mask], "rule string, bit int")
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    return (
        patterns(led).crossJoin(F.broadcast(rules))  # both sides are bounded by the number of rules
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(bits.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(bits == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when((bits == 0) | (bits == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def clean(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that a policy keeps; no shuffle."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    return apply_policy(ledger(whole, "row", "text"), version).where("kept").select("doc_id.*")
