"""Text, code and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level cuts of hierarchical codes; hydrate suffixes.
CUTS = (1, 3, 4, 5, 7)
HYDRATES = " ([012357]-WATER|WATERVRIJ)$"
WORD_SPLIT = "[^0-9a-z\\u00c0-\\u024f]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_code(code, name) -> Column:
    code, name = _c(code), _c(name)
    return F.coalesce((code != "") & (name != "") & (F.length(code) >= 7) & ~code.startswith("Q"), F.lit(False))


def ancestors(code) -> Column:
    code = _c(code)
    return F.transform(F.filter(F.array(*map(F.lit, CUTS)), lambda c: c <= F.length(code)), lambda c: F.substr(code, F.lit(1), c))


def is_combo(code) -> Column:
    code = _c(code)
    return (F.length(code) >= 7) & (F.substring(code, 6, 1) == "5")


def clean_substance(raw) -> Column:
    """At most three substances of a #-separated list, without hydrate suffix, capitalised."""
    parts = F.slice(F.filter(F.transform(F.split(_c(raw), "#"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    bare = F.transform(parts, lambda x: F.regexp_replace(x, HYDRATES, ""))
    return F.array_join(F.transform(bare, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), ", ")


def tokens(text) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit("\\p{L}{3,}"), F.lit(0)))


def word_set(text) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), WORD_SPLIT), lambda x: F.length(x) > 2))


def _until(parts: Column, stop) -> Column:
    """The elements before the first one that stop holds for."""
    hit = F.array_position(F.transform(parts, stop), F.lit(True)).cast("int")
    return F.when(hit > 0, F.slice(parts, 1, F.greatest(hit - 1, F.lit(0)))).otherwise(parts)


def brand_head(name) -> Column:
    """Up to three naming words, before the first empty part or the first with a digit."""
    parts = F.split(F.lower(F.coalesce(_c(name), F.lit(""))), WORD_SPLIT)
    head = _until(parts, lambda x: (x == "") | x.rlike("[0-9]"))
    return F.array_distinct(F.slice(F.filter(head, lambda x: F.length(x) > 2), 1, 3))


def brand_short(name) -> Column:
    """The words before the first with a digit; the whole name if none is left."""
    name = F.coalesce(_c(name), F.lit(""))
    parts = F.filter(F.split(name, "\\s+"), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(_until(parts, lambda x: x.rlike("[0-9]")), " "), F.lit("")), name)


def singular(word) -> Column:
    w = _c(word)
    return (
        F.when(w.endswith("ies"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when(w.rlike("(ses|xes|zes|ches|shes)$"), F.substr(w, F.lit(1), F.length(w) - 2))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.substr(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def leaf_query(path, hints: dict[str, str]) -> Column:
    """Singular lower-case words of a path's leaf, after a hint if the leaf has one."""
    leaf = F.element_at(F.split(_c(path), " > "), -1)
    words = F.filter(F.split(F.regexp_replace(F.lower(leaf), "&", " "), "\\s+"), lambda x: x != "")
    q = F.array_join(F.transform(words, singular), " ")
    out = None
    for k, v in hints.items():
        cond, val = leaf == k, F.concat(F.lit(v + " "), q)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return q if out is None else out.otherwise(q)


def product_text(brand, inn, form) -> Column:
    return F.array_join(F.filter(F.array(_c(brand), _c(inn), _c(form)), lambda x: x != ""), ", ")
