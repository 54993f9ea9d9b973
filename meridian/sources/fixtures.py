"""Working tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.stats import with_rank

PIVOT = "en"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, concept, lang, text, vec."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("concept"), F.col("embedding").cast("array<double>").alias("vec"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return e.join(d, "id").select("id", "concept", "lang", "text", "vec")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus without texts, which then aren't read."""
    return corpus(spark, sf_dir).drop("text")


def rotated(v: str = "vec"):
    """The query space: the vector rotated left by one."""
    return F.concat(F.slice(v, 2, 63), F.slice(v, 1, 1))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, atc, lang, brand, inn, form: registry-like rows."""
    p = read(spark, sf_dir, "part")
    types = p.select("p_type").distinct().withColumn("t", F.row_number().over(Window.orderBy("p_type")))  # a handful of types
    b = F.substring("p_brand", 7, 10).cast("int")
    code = F.concat(
        F.char(64 + F.col("t")), F.lpad(((F.col("p_size") % 3) + 1).cast("string"), 2, "0"), F.char(65 + F.col("p_size") % 2), F.char(65 + b % 2),
        F.when(F.col("p_partkey") % 3 == 0, "51").otherwise("01"),
    )
    p = p.join(F.broadcast(types), "p_type").withColumn("c", code)
    atc = F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("Q"), "c")).when(F.col("p_partkey") % 53 == 0, F.substring("c", 1, 5)).otherwise(F.col("c"))
    lang = F.get(F.array(F.lit("es"), F.lit("nl"), F.lit("pl")), (F.floor(F.col("p_partkey") / 7) % 3).cast("int"))
    return p.select(F.col("p_partkey").alias("pid"), atc.alias("atc"), lang.alias("lang"), F.col("p_name").alias("brand"), F.lower("p_type").alias("inn"), F.col("p_brand").alias("form"))


def valid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).where(T.valid_code("atc", "brand"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, level, parent of every prefix of a valid code."""
    codes = valid_products(spark, sf_dir).select("atc").distinct().select(F.explode(T.ancestors("atc")).alias("code")).distinct()
    up = T.ancestors("code")
    return codes.select("code", F.size(up).alias("level"), F.get(up, F.size(up) - 2).alias("parent"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, full_path, parts, depth, name."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    j = r.join(n, r.r_regionkey == n.n_regionkey).join(c, c.c_nationkey == n.n_nationkey)
    a = F.col("r_name")
    paths = F.array(a, F.concat_ws(" > ", a, "n_name"), F.concat_ws(" > ", a, "n_name", "c_mktsegment"), F.concat_ws(" > ", a, "n_name", "c_mktsegment", "c_name"))
    p = j.select(F.explode(paths).alias("full_path")).distinct()
    p = with_rank(p, "id", "full_path", "full_path").withColumn("id", F.col("id").cast("long"))  # stands in for the file's own ids
    parts = F.split("full_path", " > ")
    return p.select("id", "full_path", parts.alias("parts"), (F.size(parts) - 1).alias("depth"), F.element_at(parts, -1).alias("name"))


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: points inside the unit ball (5 dimensions)."""
    from ..functions import vec as V

    v5 = F.slice(F.col("embedding").cast("array<double>"), 1, 5)
    d = read(spark, sf_dir, "embeddings").select("vec_id", "label", v5.alias("v5")).withColumn("n", V.norm("v5"))
    return d.withColumn("k", F.tanh(0.15 * (1 + F.col("label")) + F.col("n")) / F.col("n")).select("vec_id", "label", V.scaled("v5", F.col("k")).alias("x"))


def text_blocks(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """scan_id, frame, pos, text, confidence, area: OCR-like blocks, lines if whole, else all their words."""
    pieces = F.split("text", "\n" if whole else "[\n ]")
    c = conversations.select("conv_id", "turn", F.posexplode(pieces).alias("p", "t"))
    c = c if whole else c.where("t <> ''")
    pos = F.col("p") + 1
    conf = F.lit(0.20) + ((F.col("conv_id") * 31 + F.col("turn") * 17 + pos * 7) % 80) / 100.0
    return c.select(F.col("conv_id").alias("scan_id"), F.col("turn").alias("frame"), pos.cast("long").alias("pos"), F.col("t").alias("text"), conf.alias("confidence"), (F.least(F.length("t"), F.lit(400)) / 2000.0).alias("area"))


def blocks(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return text_blocks(read(spark, sf_dir, "conversations"), whole)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.floor(F.col("page_id") / 3).cast("long").alias("nreg"), F.when(F.col("page_id") % 2 == 0, "materialas").otherwise("formafarmac").alias("kind"), F.col("url").alias("file"))
