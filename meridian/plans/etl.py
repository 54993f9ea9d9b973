"""Registry-like rows: filters, dedupe, codes, trees, joins, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.metrics import r4
from ..sources import fixtures as X
from .oracle import PHOTOS, PRODUCTS, TAX, TREE, VALID, ctes, query

OA = "list_transform(list_filter([1,3,4,5,7], lambda c: c <= length({0})), lambda c: substring({0}, 1, c))"


@query(ctes(PRODUCTS) + "select pid, atc, length(atc) >= 7 and brand <> '' and atc not like 'Q%' \"valid\", length(atc) >= 7 and substring(atc, 6, 1) = '5' combo, array_to_string(" + OA.format("atc") + ", '/') ancestors, array_to_string(list_filter([brand, inn, form], lambda x: x <> ''), ', ') \"text\" from products")
def code_functions(spark, d):
    p = X.products(spark, d)
    return p.select("pid", "atc", T.valid_code("atc", "brand").alias("valid"), T.is_combo("atc").alias("combo"), F.array_join(T.ancestors("atc"), "/").alias("ancestors"), T.product_text("brand", "inn", "form").alias("text"))


@query(ctes(VALID) + "select atc, lower(brand) brand, min(pid) pid, count(*) rows from valid group by 1, 2")
def first_row_dedupe(spark, d):
    """The first row of each (code, lower-case name), in input order."""
    return X.valid_products(spark, d).groupBy("atc", F.lower("brand").alias("brand")).agg(F.min("pid").alias("pid"), F.count("*").alias("rows"))


@query(ctes(VALID) + "select atc, count(*) n, min(pid) first_pid, row_number() over (order by count(*) desc, min(pid))::bigint \"rank\" from valid where lang = 'pl' group by 1 qualify \"rank\" <= 220")
def top_codes(spark, d):
    """The 220 codes with the most products, the first seen first on ties."""
    g = X.valid_products(spark, d).where("lang = 'pl'").groupBy("atc").agg(F.count("*").alias("n"), F.min("pid").alias("first_pid"))
    top = g.orderBy(F.col("n").desc(), "first_pid").limit(220)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "first_pid")).cast("long"))  # 220 rows


@query(ctes(VALID, "r as (select *, row_number() over (partition by atc, lang order by pid) rn from valid)") + "select pid, atc, lang, rn::bigint rn from r where rn <= case lang when 'pl' then 12 when 'es' then 6 else 8 end")
def group_caps(spark, d):
    """The first 12, 6 or 8 products of each code and language."""
    w = Window.partitionBy("atc", "lang").orderBy("pid")
    cap = F.when(F.col("lang") == "pl", 12).when(F.col("lang") == "es", 6).otherwise(8)
    return X.valid_products(spark, d).withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= cap).select("pid", "atc", "lang", "rn")


@query(ctes(VALID, "c as (select atc, count(*) filter (lang = 'pl') pl, count(*) filter (lang = 'es') es, count(*) filter (lang = 'nl') nl, array_to_string(list(pid order by pid) filter (lang = 'es'), ',') es_pids from valid group by 1)") + "select atc, pl, coalesce(es, 0) es, coalesce(nl, 0) nl, coalesce(es_pids, '') es_pids from c where pl > 0")
def registry_join(spark, d):
    """Left join of the registries on the code, driven by one of them."""
    v = X.valid_products(spark, d)
    pl = v.where("lang = 'pl'").groupBy("atc").agg(F.count("*").alias("pl"))
    es = v.where("lang = 'es'").groupBy("atc").agg(F.count("*").alias("es"), F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("es_pids"))
    nl = v.where("lang = 'nl'").groupBy("atc").agg(F.count("*").alias("nl"))
    return pl.join(es, "atc", "left").join(nl, "atc", "left").select("atc", "pl", F.coalesce("es", F.lit(0)).alias("es"), F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("es_pids", F.lit("")).alias("es_pids"))


@query(ctes(VALID, PHOTOS, "c as (select atc, max((lang = 'pl')::int) pl, max((lang = 'es')::int) es, max((lang = 'nl')::int) nl from valid group by 1)") + "select count(*) codes, sum((pl + es = 2)::int)::bigint pl_es, sum((pl + es + nl = 3)::int)::bigint all_three, (select count(*) from valid) products, (select count(distinct nreg) from photos) photographed, (select count(*) from valid where lang = 'es') es_products from c")
def coverage_stats(spark, d):
    v = X.valid_products(spark, d)
    c = v.groupBy("atc").agg(*[F.max((F.col("lang") == x).cast("int")).alias(x) for x in ("pl", "es", "nl")], F.count("*").alias("n"), F.sum((F.col("lang") == "es").cast("long")).alias("nes"))
    out = c.agg(F.count("*").alias("codes"), F.sum((F.col("pl") + F.col("es") == 2).cast("long")).alias("pl_es"), F.sum((F.col("pl") + F.col("es") + F.col("nl") == 3).cast("long")).alias("all_three"), F.sum("n").alias("products"), F.sum("nes").alias("es_products"))
    return out.crossJoin(F.broadcast(X.photos(spark, d).agg(F.countDistinct("nreg").alias("photographed"))))


@query(ctes(TREE) + "select t.code, t.\"level\"::int \"level\", t.parent, coalesce(n, 0)::bigint n_children, (select count(*) from tree x where x.code <> t.code and starts_with(x.code, t.code)) n_descendants from tree t left join (select parent, count(*) n from tree where parent is not null group by 1) k on k.parent = t.code")
def code_tree(spark, d):
    """Every prefix of a code with level, parent, children and descendants."""
    t = X.tree(spark, d)
    kids = t.where("parent is not null").groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("n_children"))
    up = t.select(F.explode(F.slice(T.ancestors("code"), 1, F.size(T.ancestors("code")) - 1)).alias("code")).groupBy("code").agg(F.count("*").alias("n_descendants"))
    return t.join(kids, "code", "left").join(up, "code", "left").select("code", "level", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


@query(ctes(TREE) + "select v.pid, array_to_string(list(a.lvl::varchar || ':' || a.code || ':' || coalesce(lower(t.code), '') order by a.lvl), ' ') path from valid v, (select unnest([1,3,4,5,7]) cut, unnest([1,2,3,4,5]) lvl) c, lateral (select substring(v.atc, 1, c.cut) code, c.lvl lvl) a left join tree t on t.code = a.code where c.cut <= length(v.atc) group by 1")
def code_path(spark, d):
    """A product's ancestors with level and name, in order; unknown codes have an empty name."""
    names = X.tree(spark, d).select("code", F.lower("code").alias("name"))
    p = X.valid_products(spark, d).select("pid", F.posexplode(T.ancestors("atc")).alias("l", "code")).join(names, "code", "left")
    return p.groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l"), F.concat_ws(":", (F.col("l") + 1).cast("string"), "code", F.coalesce("name", F.lit(""))).alias("s")))), lambda z: z["s"]), " ").alias("path"))


@query(ctes(TREE) + "select q.code a, d.code b, case when q.code = d.code then 'self' when starts_with(d.code, q.code) then 'descendant' when starts_with(q.code, d.code) then 'ancestor' end kin from tree q join tree d on starts_with(d.code, q.code) or starts_with(q.code, d.code)")
def prefix_join(spark, d):
    """Ancestor and descendant pairs by exploded prefixes: an equi-join in place of a prefix test."""
    t = X.tree(spark, d).select("code")
    down = t.select(F.col("code").alias("b"), F.explode(T.ancestors("code")).alias("a")).join(t.withColumnRenamed("code", "a"), "a")
    same = F.col("a") == F.col("b")
    up = down.where(~same).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("ancestor").alias("kin"))
    return down.select("a", "b", F.when(same, "self").otherwise("descendant").alias("kin")).union(up)


@query(ctes(TAX) + "select t.id, t.depth::int depth, t.\"name\", p.id parent, array_to_string(list_transform(string_split(t.full_path, '>'), lambda x: trim(x)), '/') parts from tax t left join tax p on p.full_path = array_to_string(t.parts[1:-2], ' > ') and t.depth > 0")
def taxonomy_links(spark, d):
    """Category paths parsed, with the parent's id (null for roots and missing parents)."""
    t = X.taxonomy(spark, d)
    up = F.when(F.col("depth") > 0, F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(1))), " > "))
    p = t.select(F.col("full_path").alias("up"), F.col("id").alias("parent"))
    return t.withColumn("up", up).join(p, "up", "left").select("id", "depth", "name", "parent", F.array_join(F.transform(F.split("full_path", ">"), lambda x: F.trim(x)), "/").alias("parts"))


def _closure(spark, d):
    t = X.taxonomy(spark, d)
    a = t.where("depth > 0").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", F.lit(1), k), " > "))).alias("up"))
    return t, a.join(t.select(F.col("full_path").alias("up"), F.col("id").alias("anc"), F.col("depth").alias("anc_depth")), "up").select("id", "anc", "anc_depth")


@query(ctes(TAX) + "select t.id, p.id anc, p.depth::int anc_depth from tax t join tax p on starts_with(t.full_path, p.full_path || ' > ')")
def ancestor_closure(spark, d):
    return _closure(spark, d)[1]


@query("with recursive " + TAX + ", e as (select t.id, p.id par from tax t join tax p on p.full_path = array_to_string(t.parts[1:-2], ' > ')), r as (select id, par anc, 1 steps from e union all select r.id, e.par, steps + 1 from r join e on e.id = r.anc) select id, anc, steps::int steps from r")
def recursive_closure(spark, d):
    """The same closure by a recursive common table expression over parent links; all rows, however many, and levels (Spark's own bounds are 1,000,000 and 100)."""
    taxonomy_links(spark, d).where("parent is not null").select("id", F.col("parent").alias("par")).createOrReplaceTempView("meridian_parent_links")
    return spark.sql("with recursive r(id, anc, steps) max recursion level 1000000 as (select id, par, 1 from meridian_parent_links union all select r.id, e.par, steps + 1 from r join meridian_parent_links e on e.id = r.anc) select id, anc, steps from r limit all")


@query(ctes(TAX) + "select count(*) nodes, max(depth)::int max_depth, sum((depth = 0)::int)::bigint roots, (select count(*) from tax t join tax p on starts_with(t.full_path, p.full_path || ' > ')) closure from tax")
def taxonomy_stats(spark, d):
    t, a = _closure(spark, d)
    s = t.agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), F.sum((F.col("depth") == 0).cast("long")).alias("roots"))
    return s.crossJoin(F.broadcast(a.agg(F.count("*").alias("closure"))))


@query(ctes(TAX, "l as (select t.id, t.full_path, array_to_string(t.parts[1:-2], ' > ') up from tax t where depth > 0)") + "select a.id, b.id sibling, row_number() over (partition by a.id order by b.id)::bigint \"rank\" from l a join l b on a.up = b.up and a.id <> b.id qualify \"rank\" <= 3")
def siblings(spark, d):
    """The first three other children of a node's parent, without pairing all children of a large parent."""
    t = X.taxonomy(spark, d).where("depth > 0").withColumn("up", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(1))), " > ")).select("id", "up")
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("up").orderBy("id"))).where("r <= 4").select("up", F.col("id").alias("sibling"))
    j = t.join(first, "up").where("id <> sibling")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("sibling")).cast("long")).where("rank <= 3").select("id", "sibling", "rank")


@query(ctes(TAX) + "select id, full_path from tax where contains(lower(full_path), 'build') order by id limit 40")
def category_search(spark, d):
    """Case-insensitive substring search, in id order, up to 40 answers."""
    return X.taxonomy(spark, d).where(F.contains(F.lower("full_path"), F.lit("build"))).orderBy("id").limit(40).select("id", "full_path")


@query(ctes(TAX, "n as (select count(*) c from tax)") + "select id, full_path from (select tax.*, row_number() over (order by id) - 1 rn, greatest(1, c // least(1800, c)) step from tax, n) where rn % step = 0")
def even_stride(spark, d):
    """Every step-th node, step = max(1, n // min(limit, n))."""
    t = X.taxonomy(spark, d)
    n = F.broadcast(t.agg(F.count("*").alias("c")))
    step = F.greatest(F.lit(1), F.floor(F.col("c") / F.least(F.lit(1800), F.col("c"))))
    return t.crossJoin(n).where((F.col("id") - 1) % step == 0).select("id", "full_path")


@query("with q as (select unnest([0.0, 0.1, 0.125, 0.3, 0.375, 0.6, 0.875, 1.4])::double q), a as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double a) select q, arg_min(a, abs(a - q) * 1000 + a / 1000) alpha from q, a group by 1")
def alpha_snap(spark, d):
    """The nearest served alpha, the lower one on a tie."""
    q = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.125, 0.3, 0.375, 0.6, 0.875, 1.4)], "q double")
    a = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return q.withColumn("a", a).groupBy("q").agg(F.min_by("a", F.struct(F.abs(F.col("a") - F.col("q")), "a")).alias("alpha"))


RAW = "select p_partkey pid, upper(replace(p_name, ' ', case when p_partkey % 3 = 0 then ' 1-WATER#' else '# ' end)) || case when p_partkey % 4 = 0 then ' WATERVRIJ' else '' end raw, p_name || case when p_partkey % 2 = 0 then ' ' || p_size || ' mg forte' else '' end brand from part"


@query(f"with r as ({RAW}), s as (select pid, brand, list_transform(list_filter(list_transform(string_split(raw, '#'), lambda x: trim(x)), lambda x: x <> '')[1:3], lambda x: regexp_replace(x, ' ([012357]-WATER|WATERVRIJ)$', '')) p from r), "
       "h as (select *, list_transform(regexp_split_to_array(lower(brand), '[^0-9a-z\\x{c0}-\\x{24f}]+'), lambda x: {'t': x, 'stop': x = '' or regexp_matches(x, '[0-9]')}) w, list_filter(regexp_split_to_array(brand, '\\s+'), lambda x: x <> '') b from s), "
       "k as (select *, coalesce(list_position(list_transform(w, lambda z: z.stop), true), 0) cut, coalesce(list_position(list_transform(b, lambda x: regexp_matches(x, '[0-9]')), true), 0) bcut from h) "
       "select pid, array_to_string(list_transform(p, lambda x: upper(x[1]) || lower(x[2:])), ', ') inn, array_to_string(list_sort(list_distinct(list_filter(list_transform(case when cut > 0 then w[1:cut - 1] else w end, lambda z: z.t), lambda x: length(x) > 2)[1:3])), ' ') head, coalesce(nullif(array_to_string(case when bcut > 0 then b[1:bcut - 1] else b end, ' '), ''), brand) short, array_to_string(list_sort(list_distinct(list_filter(list_transform(w, lambda z: z.t), lambda x: length(x) > 2))), ' ') words from k")
def name_cleaning(spark, d):
    """Substances, naming words, short names and word sets of raw registry strings."""
    p = X.read(spark, d, "part")
    third = F.replace(F.col("p_name"), F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.lit(" 1-WATER#")).otherwise(F.lit("# ")))
    raw = F.concat(F.upper(third), F.when(F.col("p_partkey") % 4 == 0, F.lit(" WATERVRIJ")).otherwise(F.lit("")))
    brand = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg forte"))).otherwise(F.lit("")))
    r = p.select(F.col("p_partkey").alias("pid"), raw.alias("raw"), brand.alias("brand"))
    return r.select("pid", T.clean_substance("raw").alias("inn"), F.array_join(F.array_sort(T.brand_head("brand")), " ").alias("head"), T.brand_short("brand").alias("short"), F.array_join(F.array_sort(T.word_set("brand")), " ").alias("words"))


#: Hints of leaves that mean something else by themselves.
HINTS = {"Blenders": "kitchen", "Mixers": "kitchen", "Fryers": "deep", "Grills": "barbecue", "Hoods": "range", "Steamers": "food", "Filters": "camera", "Cases": "camera", "Bags": "camera"}
LEAVES = ["Home > Kitchen > Blenders", "Vehicles > Bicycle Brake Calipers", "Toys > Puppets & Dresses", "A > Watches", "A > Glass", "A > Batteries", "Office > Boxes & Cases", "A > Bus", "A > Basis", "Camera > Bags"]
_SING = "case when w like '%ies' then w[:-4] || 'y' when regexp_matches(w, '(ses|xes|zes|ches|shes)$') then w[:-3] when w like '%s' and not regexp_matches(w, '(ss|us|is)$') then w[:-2] else w end"


@query(
    f"with l as (select unnest({LEAVES}) path), s as (select path, string_split(path, ' > ')[-1] leaf from l), t as (select path, leaf, unnest(w) w, generate_subscripts(w, 1) i from (select *, list_filter(regexp_split_to_array(replace(lower(leaf), '&', ' '), '\\s+'), lambda x: x <> '') w from s)), "
    "g as (select path, leaf, array_to_string(list(" + _SING + " order by i), ' ') q from t group by 1, 2), h as (select unnest(" + str(list(HINTS)) + ") leaf, unnest(" + str(list(HINTS.values())) + ") hint) select path, coalesce(hint || ' ', '') || q query from g left join h using (leaf)"
)
def leaf_queries(spark, d):
    return spark.createDataFrame([(x,) for x in LEAVES], "path string").select("path", T.leaf_query("path", HINTS).alias("query"))


@query(ctes(PHOTOS) + "select d.doc_id, arg_min(p.file, (p.kind <> 'materialas')::int * 1000000000 + p.page_id) file, count(p.page_id) n from documents d left join photos p on p.nreg = d.doc_id group by 1")
def photo_join(spark, d):
    """The best photo of exactly this registration number; never another product's."""
    p = X.photos(spark, d)
    best = p.groupBy(F.col("nreg").alias("doc_id")).agg(F.min_by("file", F.struct(F.when(F.col("kind") == "materialas", 0).otherwise(1), "page_id")).alias("file"), F.count("*").alias("n"))
    return X.read(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").fillna(0, ["n"])


@query(ctes(PHOTOS) + "select p.nreg, p.kind, replace(p.file, '/thumb/', '/full/') file from photos p where not exists (select 1 from photos q where q.nreg = p.nreg and q.kind <> p.kind and q.page_id < p.page_id)")
def photo_todo(spark, d):
    """Photos still to fetch: an anti-join against earlier ones of the same number."""
    p = X.photos(spark, d)
    q = p.select(F.col("nreg").alias("n"), F.col("kind").alias("k"), F.col("page_id").alias("pg"))
    left = p.join(q, (p.nreg == q.n) & (p.kind != q.k) & (q.pg < p.page_id), "left_anti")
    return left.select("nreg", "kind", F.replace("file", F.lit("/thumb/"), F.lit("/full/")).alias("file"))


@query(ctes(TREE, "n as (select code, 'name of ' || code nm from tree where length(code) < 5)") + "select t.code, coalesce(nullif(case when t.code like 'A%' then 'own ' || t.code else '' end, ''), n.nm) \"name\" from tree t left join n using (code)")
def name_fill(spark, d):
    """Empty names are filled from an index, given ones stay."""
    t = X.tree(spark, d).select("code", F.when(F.col("code").startswith("A"), F.concat(F.lit("own "), "code")).otherwise(F.lit("")).alias("own"))
    n = X.tree(spark, d).where(F.length("code") < 5).select("code", F.concat(F.lit("name of "), "code").alias("nm"))
    return t.join(n, "code", "left").select("code", F.coalesce(F.nullif("own", F.lit("")), "nm").alias("name"))


@query(ctes(VALID) + "select pid, atc from valid v where lang = 'pl' and exists (select 1 from valid e where e.lang = 'es' and e.atc = v.atc)")
def shelf_semi_join(spark, d):
    """Queries whose code is on the target shelf."""
    v = X.valid_products(spark, d)
    return v.where("lang = 'pl'").join(v.where("lang = 'es'").select("atc"), "atc", "left_semi").select("pid", "atc")


@query(ctes(VALID) + "select atc from (select atc from valid where lang = 'pl' intersect select atc from valid where lang = 'es' intersect select atc from valid where lang = 'nl')")
def code_intersection(spark, d):
    """Codes that every language has (one grouping instead of three shuffles)."""
    v = X.valid_products(spark, d)
    return v.groupBy("atc").agg(F.countDistinct("lang").alias("n")).where("n = 3").select("atc")


@query(ctes(VALID) + "select lang, count(*) n, count(distinct atc) codes, count(distinct lower(brand)) brands from valid group by 1")
def corpus_meta(spark, d):
    return X.valid_products(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("atc").alias("codes"), F.countDistinct(F.lower("brand")).alias("brands"))


@query("select doc_id, row_number() over (order by (doc_id * 7919 + 104729) % 1000003, doc_id)::bigint \"rank\" from documents qualify \"rank\" <= 300")
def seeded_sample(spark, d):
    """A reproducible sample: the 300 smallest arithmetic hashes of the id."""
    h = (F.col("doc_id") * 7919 + 104729) % 1000003
    s = X.read(spark, d, "documents").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(300)
    return s.select("doc_id", F.row_number().over(Window.orderBy("h", "doc_id")).cast("long").alias("rank"))  # 300 rows


#: Words that rule an image title out, and licences that are accepted.
BAD_TITLE = "logo|icon|map|diagram|chart|coat of arms|flag of|svg|\\.pdf|\\.ogv|\\.webm|\\.tif|screenshot|poster|painting|drawing|stamp|banknote|postcard|patent"
GOOD_LICENCE = "cc|public domain|pd-|cc0"


@query(
    f"with i as (select page_id, url title, case when page_id % 3 = 0 then 'CC BY-SA 4.0' when page_id % 3 = 1 then 'Public Domain' else 'All rights reserved' end licence, '<a href=\"x\">By ' || regexp_extract(url, '://([^/]*)', 1) || '</a>' author, page_id % 20 cat from pages) "
    f"select page_id, cat, substring(regexp_replace(author, '<[^>]*>', '', 'g'), 1, 60) author, row_number() over (partition by cat order by page_id)::bigint rn from i where not regexp_matches(lower(title), '{BAD_TITLE}') and regexp_matches(lower(licence), '{GOOD_LICENCE}') qualify rn <= 4"
)
def image_filter(spark, d):
    """Title denylist, licence allowlist, plain credit line, at most four images a category."""
    p = X.read(spark, d, "pages")
    m = F.col("page_id") % 3
    i = p.select("page_id", F.col("url").alias("title"), F.when(m == 0, "CC BY-SA 4.0").when(m == 1, "Public Domain").otherwise("All rights reserved").alias("licence"), F.concat(F.lit('<a href="x">By '), F.regexp_extract("url", "://([^/]*)", 1), F.lit("</a>")).alias("author"), (F.col("page_id") % 20).alias("cat"))
    ok = i.where(~F.lower("title").rlike(BAD_TITLE) & F.lower("licence").rlike(GOOD_LICENCE))
    w = Window.partitionBy("cat").orderBy("page_id")
    return ok.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 4").select("page_id", "cat", F.substring(F.regexp_replace("author", "<[^>]*>", ""), 1, 60).alias("author"), "rn")


@query("select event_type, count(*) n, round(avg(value), 4) mean, count(distinct json_extract_string(props, '$.' || json_keys(props)[1])) firsts from events group by 1")
def json_functions(spark, d):
    """Scalars out of JSON text."""
    e = X.read(spark, d, "events")
    first = F.expr("get(map_values(from_json(props, 'map<string,string>')), 0)")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r4(F.avg("value")).alias("mean"), F.countDistinct(first).alias("firsts"))
