"""Readers of registries, taxonomies and vector files, and writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.stats import with_rank

ES_SCHEMA = (
    "nombre string, nregistro string, vtm struct<nombre:string>, dosis string, cpresc string, generico boolean, "
    "formaFarmaceuticaSimplificada struct<nombre:string>, fotos array<struct<tipo:string,url:string>>, atc string"
)
TREE_SCHEMA = "code string, level int, name string, parent string"


def _first_by_name(df: DataFrame) -> DataFrame:
    """The first row of each (code, lower-case name); ord is the input order."""
    best = df.groupBy("atc", F.lower("brand").alias("_k")).agg(F.min_by(F.struct(*df.columns), "ord").alias("r"))
    return best.select("r.*")


def registry_positional(spark: SparkSession, path: str) -> DataFrame:
    """A ;-separated registry without usable names: columns by place; rows of fewer than 16 are dropped."""
    value = F.regexp_replace("value", "^\\ufeff", "")
    lines = spark.read.text(path).select(value.alias("value"), F.monotonically_increasing_id().alias("ord"))
    head = lines.orderBy("ord").limit(1).collect()  # the header; files of one registry have the same
    cols = F.from_csv("value", ", ".join(f"c{i} string" for i in range(16)), {"sep": ";", "mode": "PERMISSIVE"})
    width = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), ";"))  # separators in quotes don't count
    r = lines.where((width >= 16) & (F.col("value") != (head[0]["value"] if head else ""))).select("ord", cols.alias("c"))
    t = {n: F.coalesce(F.trim(F.col(f"c.c{i}")), F.lit("")) for n, i in (("brand", 1), ("inn", 2), ("strength", 7), ("form", 8), ("atc", 12), ("holder", 13))}
    t["holder"] = F.substring(t["holder"], 1, 60)
    return _first_by_name(r.select("ord", *[c.alias(n) for n, c in t.items()]).where(X.valid_code("atc", "brand"))).drop("ord")


def registry_named(spark: SparkSession, path: str) -> DataFrame:
    """A |-separated registry with a header; the code stands before ' - '.  A missing file gives no rows."""
    schema = "atc string, brand string, inn string, form string, strength string, holder string, rvg string"
    try:
        r = spark.read.csv(path, sep="|", header=True, maxCharsPerColumn=10_000_000)
    except Exception as e:  # the analyser names a missing path
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    r = r.withColumn("ord", F.monotonically_increasing_id())
    names = {"brand": "PRODUCTNAAM", "form": "FARMACEUTISCHEVORM", "strength": "POTENTIE", "holder": "HANDELSVERGUNNINGHOUDER", "rvg": "REGISTRATIENUMMER"}
    out = r.select("ord", F.trim(F.get(F.split(F.coalesce("ATC", F.lit("")), " - "), F.lit(0))).alias("atc"), X.clean_substance(F.coalesce("WERKZAMESTOFFEN", F.lit(""))).alias("inn"), *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(n) for n, c in names.items()])
    return _first_by_name(out.where(X.valid_code("atc", "brand"))).select("atc", "brand", "inn", "form", "strength", "holder", "rvg")


def registry_json(spark: SparkSession, path: str, per_code: int = 6) -> DataFrame:
    """JSON products (one a line); nested values may be missing; the first per_code of each code."""
    r = spark.read.schema(ES_SCHEMA).json(path).withColumn("ord", F.monotonically_increasing_id())
    e = F.lit("")
    out = r.select("ord", "atc", F.coalesce("nombre", e).alias("brand"), F.coalesce("vtm.nombre", e).alias("inn"), F.coalesce("formaFarmaceuticaSimplificada.nombre", e).alias("form"), F.coalesce("dosis", e).alias("strength"), F.coalesce("nregistro", e).alias("nreg"), F.coalesce("cpresc", e).alias("otc"), F.coalesce("generico", F.lit(False)).alias("generic"), F.coalesce("fotos", F.array().cast("array<struct<tipo:string,url:string>>")).alias("photos"))
    w = Window.partitionBy("atc").orderBy("ord")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_code).drop("rn", "ord")


def code_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Paged JSON answers of a code index (a file each, or one a line): code, name; the first answer for a code counts."""
    r = spark.read.schema("resultados array<struct<codigo:string,nombre:string>>").json(path, multiLine=not lines)
    r = r.select(F.monotonically_increasing_id().alias("page"), F.posexplode("resultados").alias("pos", "r"))
    return r.groupBy(F.col("r.codigo").alias("code")).agg(F.min_by("r.nombre", F.struct("page", "pos")).alias("name"))


def taxonomy_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'id - A > B > C'; blank lines and comments are skipped."""
    r = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    full = F.regexp_extract("value", "^[^-]*? - (.*)$", 1)
    parts = F.transform(F.split(full, ">"), lambda x: F.trim(x))
    t = r.select(F.regexp_extract("value", "^\\s*(\\d+)", 1).cast("long").alias("id"), full.alias("full_path"), parts.alias("parts")).where("id is not null")
    return t.withColumns({"depth": F.size("parts") - 1, "name": F.element_at("parts", -1)})


def parallel(files: dict[str, DataFrame]) -> DataFrame:
    """lang, id, leaf, full_path of the ids that every language has."""
    out = None
    for lang, t in files.items():
        t = t.select(F.lit(lang).alias("lang"), "id", F.col("name").alias("leaf"), "full_path")
        out = t if out is None else out.unionByName(t)
    every = out.groupBy("id").agg(F.countDistinct("lang").alias("n")).where(F.col("n") == len(files)).select("id")
    return out.join(every, "id", "left_semi")


def named_vector(df: DataFrame, vectors: str, name: str | None = None) -> DataFrame:
    """vec from a struct of vectors: by name, or the only one there is."""
    fields = df.schema[vectors].dataType.fieldNames()
    if name is None and len(fields) != 1:
        raise ValueError(f"name one of {fields}")
    if name is not None and name not in fields:
        raise ValueError(f"no vector {name!r}; there are {fields}")
    return df.withColumn("vec", F.col(f"{vectors}.{name or fields[0]}"))


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id (row number) and vec of two-dimensional .npy files, read through Spark's binary source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for content in b["content"]:
                a = np.load(io.BytesIO(content))
                for i in range(0, len(a), 4096):
                    yield pd.DataFrame({"id": np.arange(i, min(i + 4096, len(a))), "vec": [v.tolist() for v in a[i : i + 4096]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, vec array<float>")


def half(df: DataFrame, vec: str = "vec") -> DataFrame:
    """id, bytes (little-endian 16-bit floats), drift: the largest change that the cast makes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a = np.array(b[vec].tolist(), dtype=np.float32)
                h = a.astype("<f2")
                yield pd.DataFrame({"id": b["id"], "bytes": [x.tobytes() for x in h], "drift": np.abs(a - h.astype(np.float32)).max(1).astype(float)})

    return df.select("id", vec).mapInPandas(run, "id long, bytes binary, drift double")


def unhalf(df: DataFrame) -> DataFrame:
    """id, vec from 16-bit bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": [np.frombuffer(x, "<f2").astype(float).tolist() for x in b["bytes"]]})

    return df.select("id", "bytes").mapInPandas(run, "id long, vec array<double>")


def with_offsets(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds offset: where a row's bytes begin if all are written one after the other in the order of ids."""
    size = df.select(F.max(F.octet_length("bytes"))).first()[0] or 0
    out = with_rank(df.select(id_col, "bytes"), "place", id_col, id_col)
    return out.withColumn("offset", ((F.col("place") - 1) * size).cast("long")).drop("place")


def write_vectors(df: DataFrame, path: str) -> None:
    """A vector collection as Parquet; writing again replaces it."""
    df.write.mode("overwrite").parquet(path)


def upsert_vectors(df: DataFrame, path: str, id_col: str = "id") -> str:
    """A new version of the collection beside the old one: df's rows, and the old rows of other ids; returns its path.

    The old version stays readable until the caller drops it, so a job that dies halfway loses nothing.
    """
    old = df.sparkSession.read.parquet(path)
    new = path.rstrip("/") + "-next"
    df.unionByName(old.join(df.select(id_col), id_col, "left_anti"), allowMissingColumns=True).write.mode("overwrite").parquet(new)
    return new


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
