"""Readers and writers as queries: files in the registries' formats, made from the test tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as X
from ..sources import readers as R
from ..storage import new_path
from .oracle import CORPUS, PRODUCTS, TAX, VALID, ctes, query

FIRST = "first as (select atc, arg_min(brand, pid) brand, arg_min(form, pid) form, arg_min(strength, pid) strength from (select *, pid || ' mg' strength from valid) group by atc, lower(brand))"


def _products(spark, d):
    return X.products(spark, d).withColumn("strength", F.concat(F.col("pid").cast("string"), F.lit(" mg")))


@query(ctes(VALID, FIRST) + "select atc, brand, form, strength from first")
def registry_positional_file(spark, d):
    """A ;-separated file of 16 unnamed columns with quoted separators, short rows and a header."""
    path = new_path(spark, "registry-positional")
    e = F.lit("")
    p = _products(spark, d).orderBy("pid")
    cells = [F.col("pid").cast("string"), F.col("brand"), F.lit('"inn; salt"'), *[e] * 4, F.col("strength"), F.col("form"), *[e] * 3, F.col("atc"), F.lit("holder"), e, e]
    rows = p.select(F.concat_ws(";", *cells).alias("value"), "pid")
    short = p.select(F.concat_ws(";", F.lit("1"), F.col("brand")).alias("value"), "pid").where("pid % 10 = 0")
    head = spark.createDataFrame([(";".join(f"column {i}" for i in range(16)), -1)], "value string, pid long")
    head.union(rows).union(short).orderBy("pid").coalesce(1).select("value").write.text(path)  # a registry is one file
    return R.registry_positional(spark, path).select("atc", "brand", "form", "strength")


@query(ctes(VALID, FIRST) + "select atc, brand, form, strength from first")
def registry_named_file(spark, d):
    """A |-separated file with a header; the code stands before ' - '."""
    path = new_path(spark, "registry-named")
    p = _products(spark, d).orderBy("pid").coalesce(1)  # a registry is one file
    names = {"ATC": F.concat("atc", F.lit(" - "), "inn"), "PRODUCTNAAM": F.col("brand"), "WERKZAMESTOFFEN": F.col("inn"), "FARMACEUTISCHEVORM": F.col("form"), "POTENTIE": F.col("strength"), "HANDELSVERGUNNINGHOUDER": F.lit("holder"), "REGISTRATIENUMMER": F.col("pid").cast("string")}
    p.select(*[c.alias(n) for n, c in names.items()]).write.csv(path, sep="|", header=True)
    return R.registry_named(spark, path).select("atc", "brand", "form", "strength")


@query(ctes(PRODUCTS, "r as (select atc, brand, coalesce(case when pid % 3 <> 0 then inn end, '') inn, form, (pid % 2)::bigint n_photos, row_number() over (partition by atc order by pid) r from products qualify r <= 6)") + "select atc, brand, inn, form, n_photos from r")
def registry_json_file(spark, d):
    """JSON products with missing nested values, the first six of each code."""
    path = new_path(spark, "registry-json")
    p = X.products(spark, d).orderBy("pid").coalesce(1)  # a registry is one file
    photo = F.struct(F.lit("materialas").alias("tipo"), F.concat(F.lit("u"), F.col("pid").cast("string")).alias("url"))
    vtm, form = F.struct(F.col("inn").alias("nombre")), F.struct(F.col("form").alias("nombre"))
    p = p.select(F.col("brand").alias("nombre"), F.col("pid").cast("string").alias("nregistro"), F.when(F.col("pid") % 3 != 0, vtm).alias("vtm"), form.alias("formaFarmaceuticaSimplificada"), F.when(F.col("pid") % 2 == 1, F.array(photo)).alias("fotos"), "atc")
    R.write_json(p, path)
    return R.registry_json(spark, path).select("atc", "brand", "inn", "form", F.coalesce(F.size("photos"), F.lit(0)).cast("long").alias("n_photos"))


@query(ctes(VALID) + "select atc code, arg_min(brand, pid) \"name\" from valid group by 1")
def code_index_file(spark, d):
    """Paged answers of a code index; the first answer for a code counts."""
    path = new_path(spark, "code-index")
    p = X.valid_products(spark, d).withColumn("page", F.floor(F.col("pid") / 200))
    pages = p.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pid", F.col("atc").alias("codigo"), F.col("brand").alias("nombre")))).alias("resultados"))
    R.write_json(pages.orderBy("page").coalesce(1).select(F.transform("resultados", lambda x: F.struct(x["codigo"].alias("codigo"), x["nombre"].alias("nombre"))).alias("resultados"), F.lit(200).alias("tamanioPagina")), path)
    return R.code_index(spark, path, lines=True)


@query(ctes(TAX) + "select id, full_path, depth, name from tax")
def taxonomy_file(spark, d):
    """Category paths written as lines with comments and blank lines, read back."""
    path = new_path(spark, "taxonomy")
    t = X.taxonomy(spark, d)
    lines = t.select(F.concat(F.col("id").cast("string"), F.lit(" - "), "full_path").alias("value"))
    lines.union(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return R.taxonomy_text(spark, path).select("id", "full_path", F.col("depth").cast("long").alias("depth"), "name")


@query(ctes(TAX) + "select l lang, id, name leaf from tax, (select unnest(['en', 'de']) l) where id % 3 <> 0")
def parallel_taxonomies(spark, d):
    """Categories that the files of every language have."""
    t = X.taxonomy(spark, d)
    return R.parallel({"en": t, "de": t.where("id % 3 <> 0")}).select("lang", "id", "leaf")


@query(ctes(CORPUS) + "select id, lang, round(vec[1], 4) + 0.0 first, round(vec[64], 4) + 0.0 last from corpus")
def vector_collection(spark, d):
    """A vector collection written in two goes, each id once, with its payload, and read back by the vector's name."""
    path = new_path(spark, "vectors")
    c = X.vectors(spark, d)
    R.write_vectors(c.where("id % 2 = 0"), path)
    path = R.upsert_vectors(c, path)
    back = spark.read.parquet(path).select("id", "lang", F.struct(F.col("vec").alias("dense")).alias("vectors"))
    v = R.named_vector(back, "vectors", "dense")
    return v.select("id", "lang", (F.round(F.get("vec", F.lit(0)), 4) + 0.0).alias("first"), (F.round(F.get("vec", F.lit(63)), 4) + 0.0).alias("last"))


@query(ctes(CORPUS) + "select id, 128::bigint bytes, (row_number() over (order by id) - 1)::bigint * 128 \"offset\" from corpus")
def half_export(spark, d):
    """A 16-bit export with each row's place in the file: ids in order, 128 bytes a vector."""
    h = R.half(X.vectors(spark, d).select("id", "vec"))
    return R.with_offsets(h).select("id", F.octet_length("bytes").cast("long").alias("bytes"), "offset")


@query(ctes(PRODUCTS) + "select pid, atc, lang, brand from products")
def json_export(spark, d):
    """Rows written as JSON and read back."""
    path = new_path(spark, "json")
    R.write_json(X.products(spark, d).select("pid", "atc", "lang", "brand"), path)
    return spark.read.schema("pid long, atc string, lang string, brand string").json(path)
