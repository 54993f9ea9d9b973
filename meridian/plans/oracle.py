"""DuckDB text of the working tables, and the registration of queries."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the equivalent DuckDB text."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


CORPUS = "corpus as (select e.vec_id id, e.label concept, d.lang, d.text, list_transform(e.embedding, lambda x: x::double) vec from embeddings e join documents d on e.vec_id = d.doc_id)"


def nrm(x: str) -> str:
    return f"list_transform({x}, lambda z: z / greatest(sqrt(list_inner_product({x}, {x})), 1e-12))"


def offs(name: str = "offs", src: str = "corpus", vec: str = "vec", cond: str = "true") -> str:
    return (
        f"{name}_first as (select concept, lang, min(id) id from {src} where {cond} group by 1, 2), "
        f"{name}_pairs as (select a.concept, a.lang, a.id a, b.id b from {name}_first a join {name}_first b on a.concept = b.concept and b.lang = 'en' where a.lang <> 'en'), "
        f"{name}_m as (select p.lang, u.pos, avg(x.{vec}[u.pos] - y.{vec}[u.pos]) m from {name}_pairs p join {src} x on x.id = p.a join {src} y on y.id = p.b, (select unnest(range(1, 65)) pos) u group by 1, 2), "
        f"{name} as (select lang, list(m order by pos) off from {name}_m group by 1)"
    )


def shifted(name: str, alphas: list[float], src: str = "corpus", off: str = "offs", vec: str = "vec") -> str:
    return (
        f"{name}_raw as (select a.alpha, c.id, c.concept, c.lang, c.{vec} orig, o.off is null as is_pivot, case when o.off is null then c.{vec} else list_transform(list_zip(c.{vec}, o.off), lambda p: p[1] - a.alpha * p[2]) end v "
        f"from {src} c left join {off} o on c.lang = o.lang, (select unnest({[float(a) for a in alphas]})::double alpha) a), "
        f"{name} as (select alpha, alpha::varchar part, id, concept, lang, orig, case when is_pivot then v else {nrm('v')} end vec from {name}_raw)"
    )


DOT = "list_inner_product(q.vec, d.vec)"
SQD = "list_sum(list_transform(list_zip(q.vec, d.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def poincare(q: str = "q.vec", d: str = "d.vec") -> str:
    sq = f"list_sum(list_transform(list_zip({q}, {d}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"acosh(greatest(1 + 2 * {sq} / ((1 - least(list_inner_product({q}, {q}), 1 - 1e-9)) * (1 - least(list_inner_product({d}, {d}), 1 - 1e-9))), 1.0))"


def knn(name: str, q: str, d: str, k: int, expr: str = DOT, on: str = "q.part = d.part and q.id <> d.id") -> str:
    return (
        f"{name}_all as (select q.part part, q.id query_id, d.id doc_id, round({expr}, 9) score from {q} q join {d} d on {on}), "
        f"{name} as (select *, row_number() over (partition by part, query_id order by score desc, doc_id) \"rank\" from {name}_all qualify \"rank\" <= {k})"
    )


BALL = (
    "ball as (select vec_id id, label, '' part, list_transform(v5, lambda x: x * (tanh(0.15 * (1 + label) + n) / n)) vec from (select vec_id, label, v5, sqrt(list_inner_product(v5, v5)) n "
    "from (select vec_id, label, list_transform(embedding[1:5], lambda x: x::double) v5 from embeddings)))"
)
PRODUCTS = (
    "products as (select p_partkey pid, case when p_partkey % 50 = 0 then 'Q' || c when p_partkey % 53 = 0 then substring(c, 1, 5) else c end atc, "
    "['es','nl','pl'][1 + ((p_partkey // 7) % 3)::int] lang, p_name brand, lower(p_type) inn, p_brand form "
    "from (select *, chr(64 + t::int) || lpad(((p_size % 3) + 1)::varchar, 2, '0') || chr(65 + (p_size % 2)::int) || chr(65 + (b % 2)::int) || case when p_partkey % 3 = 0 then '51' else '01' end c "
    "from (select *, dense_rank() over (order by p_type) t, cast(substring(p_brand, 7) as int) b from part)))"
)
VALID = PRODUCTS + ", valid as (select * from products where length(atc) >= 7 and atc <> '' and brand <> '' and atc not like 'Q%')"
TREE = VALID + (
    ", tree as (select distinct substring(atc, 1, cut) code, lvl \"level\", case when lvl > 1 then substring(atc, 1, [1,3,4,5,7][(lvl - 1)::int]) end parent "
    "from valid, (select unnest([1,3,4,5,7]) cut, unnest([1,2,3,4,5]) lvl) where cut <= length(atc))"
)
TAX = (
    "tax_p as (select distinct unnest([r_name, r_name || ' > ' || n_name, r_name || ' > ' || n_name || ' > ' || c_mktsegment, r_name || ' > ' || n_name || ' > ' || c_mktsegment || ' > ' || c_name]) full_path "
    "from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey), "
    "tax as (select row_number() over (order by full_path) id, full_path, string_split(full_path, ' > ') parts, len(string_split(full_path, ' > ')) - 1 depth, string_split(full_path, ' > ')[-1] \"name\" from tax_p)"
)


def blocks(whole: bool = False) -> str:
    """Blocks of text: lines if whole, else all their words."""
    pieces = "string_split(\"text\", chr(10))" if whole else "string_split(replace(\"text\", chr(10), ' '), ' ')"
    return (
        "blocks as (select conv_id scan_id, turn frame, pos, t \"text\", 0.20::double + ((conv_id * 31 + turn * 17 + pos * 7) % 80) / 100.0::double confidence, least(length(t), 400) / 2000.0::double area "
        f"from (select conv_id, turn, unnest({pieces}) t, generate_subscripts({pieces}, 1) pos from conversations) {'' if whole else "where t <> ''"})"
    )


PHOTOS = "photos as (select page_id, page_id // 3 nreg, case when page_id % 2 = 0 then 'materialas' else 'formafarmac' end kind, url file from pages)"
