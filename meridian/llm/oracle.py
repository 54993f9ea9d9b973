"""DuckDB equivalents of the operators that SQL can express."""

from __future__ import annotations

from . import quality, url_filter

_WORDS = "w as (select doc_id, coalesce(\"text\", '') t, regexp_extract_all(coalesce(\"text\", ''), '[^\\x20\\x09-\\x0D]+') w from documents)"
_RULES = " + ".join(f"case when {failure} then {quality.BIT[name]} else 0 end" for name, failure in quality.RULES)

QUALITY = f"""with {_WORDS},
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from w)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct i + k) n from rep, (select unnest(range(0, 5)) k) group by 1),
l as (select doc_id, w, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from w),
m as (select l.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
 len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::bigint n_upper from l left join cov using (doc_id)),
b as (select *, ({_RULES})::int fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality.POLICIES["base"]}) <> 0 base_failed, (fail_bits & {quality.POLICIES["v1"]}) = 0 kept, fail_bits from b"""

JACCARD = f"""with recursive {_WORDS},
sh as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w)),
n as (select doc_id, count(*) n from sh group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
j as (select a, b, c = x.n and c = y.n copies from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
e as (select a, b, copies from j union all select b, a, copies from j),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
k as (select a, min(b) m from r group by 1), g as (select a, count(*) links, sum(copies::int) copies from e group by 1)
select w.doc_id, least(w.doc_id, coalesce(k.m, w.doc_id)) class_id, coalesce(g.links, 0)::bigint n_links, (1 + coalesce(g.copies, 0))::bigint n_copies, coalesce(n.n, 0)::bigint n_shingles
from w left join k on k.a = w.doc_id left join g on g.a = w.doc_id left join n on n.doc_id = w.doc_id"""


def _case(column: str) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    value = {"rule": lambda h, p, v: h + p, "verdict": lambda h, p, v: v}[column]
    return "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(h, p, v)}'" for h, p, v in rules) + " end"


def _levels() -> str:
    out = ["s4 as (select gram g, sum(case when back then 0 else a end) a, sum(case when back then 0 else r end) r from ex group by 1)"]
    out += [f"s{k} as (select substring(g, 2) g, sum(a) a, sum(r) r from s{k + 1} group by 1)" for k in (3, 2, 1)]
    for k in (1, 2, 3, 4):
        below = {c: f"l.p{c}" if k > 1 else f"(1.0::double / {url_filter.ALPHABET})" for c in "ar"}
        part = "over (partition by substring(g, 1, length(g) - 1))"
        p = ", ".join(f"case when n{c} > 0 then (s.{c} + t{c} * {below[c]}) / (n{c} + t{c})::double else {below[c]} end p{c}" for c in "ar")
        out.append(f"c{k} as (select *, sum(a) {part} na, sum(r) {part} nr, sum((a > 0)::int) {part} ta, sum((r > 0)::int) {part} tr from s{k})")
        out.append(f"l{k} as (select s.g, {p} from c{k} s" + (f" join l{k - 1} l on l.g = substring(s.g, 2)" if k > 1 else "") + ")")
    return ",\n".join(out)


_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LOW = f"'{url_filter._UPPER}', '{url_filter._LOWER}'"
URLS = f"""with p0 as (select page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), {_LOW}) host, regexp_extract(coalesce(url, ''), '{_URL}', 2) path from pages),
p as (select *, {_case("rule")} "rule", {_case("verdict")} ruled, '^^^' || regexp_replace(regexp_replace(translate(host || path, {_LOW}), '[0-9]', '0', 'g'), '[^a-z0./_~%:-]', '?', 'g') || '$' s from p0),
u as (select s, sum(coalesce(ruled = 'allow', false)::int) a, sum(coalesce(ruled = 'block', false)::int) r, ('0x' || substring(md5(s), 1, 4))::int % {url_filter.FOLDS} = 0 back from p group by 1),
ex as (select s, a, r, back, substring(s, i, 4) gram from (select *, unnest(range(1, length(s) - 2)) i from u)),
{_levels()},
sc as (select s, a, r, back, round(sum(ln(pa) - ln(pr)) / count(*), 9) score from ex join l4 on l4.g = ex.gram group by 1, 2, 3, 4),
ok as (select max(case when a > 0 then back end) ba, max(case when r > 0 then back end) br from sc),
use as (select score, case when back or not (ba and br) then a else 0 end a, case when back or not (ba and br) then r else 0 end r from sc, ok),
mo as (select sum(a * score) / sum(a) ma, sqrt(greatest(sum(a * score * score) / sum(a) - (sum(a * score) / sum(a)) ** 2, 0)) sa, sum(r * score) / sum(r) mr, sqrt(greatest(sum(r * score * score) / sum(r) - (sum(r * score) / sum(r)) ** 2, 0)) sr, sum(a) na, sum(r) nr from use),
th as (select round(case when na > 0 and nr > 0 then case when sa + sr > 0 then (ma * sr + mr * sa) / (sa + sr) else (ma + mr) / 2 end end, 9) threshold from mo)
select page_id, host, path, "rule", coalesce(ruled, case when threshold is null or score >= threshold then 'allow' else 'block' end) verdict, score, threshold from p join sc using (s), th"""

ORACLE = {"op1_quality_rules": QUALITY, "op5_jaccard_join": JACCARD, "op6_url_filter": URLS}
