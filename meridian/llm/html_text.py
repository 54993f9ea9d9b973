"""Main text of web pages by the maximum-scoring run of blocks.

A page is read by the rules of HTML: quotes count only in attribute values, ``p``, ``li`` and the like
close by themselves, stray and misnested end tags are allowed, and a tag that the page's end cuts off is
no text.  Reading takes time in proportion to the page whatever stands in it.

Words score positive and tags negative.  The weights are log odds of standing inside the content against
outside it, counted on pages that mark their content themselves (``article`` or ``main``): of every tag,
of words by the names around them (classes, ids, roles and elements such as ``nav``), and of words outside
of the marks of a page that has marks.  One linear scan over the page's blocks finds the contiguous run
with the highest sum; the text is the run's blocks, white space inside a block as one space, joined by one
space.  A run that touches a mark takes the whole mark (nested marks belong to the outermost); what lies
between marks of one parent neither scores nor appears, so a story in several marks stays whole.

Elements that the contract leaves out wherever they stand (menus, forms, adverts, comments, scripts ...)
are known by fixed names; each is one negative token and never appears.  One without an end tag ends where
the page's first mark begins.  ``names=False`` and ``marks=False`` switch the fixed names and the marks
off, which leaves the scan to the counted weights alone.

Null or empty html, and pages without any word, give an empty text.  Null ids, repeated rows and extra
columns of any name are allowed; an empty table gives an empty table; pages are used whole.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Pages from which weights are counted, at most: those with the smallest hashes of their ids.
LABELLED_PAGES = 400
#: Elements and names that are never content, and how HTML sorts its elements.
NEVER = frozenset("head nav footer aside form button dialog menu label fieldset legend select option iframe object svg noscript".split())
BOILERPLATE = re.compile(
    r"(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:^|(?<=[\s_-]))(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion|ted)?|banner|sidebar|widget|nav|navbar|navigation|menu|breadcrumbs?"
    r"|footer|masthead|topbar|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search"
    r"|comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|complementary|contentinfo)(?:$|(?=[\s_-]))",
    re.I,
)
HEADER = re.compile(r"(?:^|\s)(?:header|site-header|page-header|top-header|banner)(?:$|\s)", re.I)
UNSEEN = frozenset("script style template title textarea xmp noembed noframes".split())  # their content is no markup, or not shown
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot")}
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
LIST_SCOPE = (*SCOPE, "ul", "ol", "menu", "dir", "dl", "select", "article", "main", "section", "aside", "nav", "header", "footer", "form", "blockquote", "figure", "details")
#: Elements whose names say nothing about the words in them; the others that HTML gives a meaning.
SPOKEN = frozenset("nav footer aside header form menu button label".split())

_SPACE = " \t\n\f\r"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^{_SPACE}/>]*+)")
_ATTRIBUTE = re.compile(rf"[{_SPACE}/]*+(?:(>)|(=?[^{_SPACE}/>=]*+)(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^{_SPACE}>]*+)))?+)")
_LABELS = frozenset(("class", "id", "role", "aria-label"))
_RAW_END = {name: re.compile(rf"</{name}(?=[{_SPACE}/>])", re.I) for name in UNSEEN - {"template"}}


def tokens(page: str) -> Iterator[tuple[int, str, str]]:
    """(kind, name, data): 0 text, 1 start tag with its class, id and role names, 2 end tag."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 == size:
            yield 0, "", page[at:]
            return
        m = _TAG.match(page, lt)
        if m is None:
            if page[lt + 1] not in "!?/":  # a plain character
                yield 0, "", page[at : lt + 1]
                at = lt + 1
                continue
            if lt > at:
                yield 0, "", page[at:lt]
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
            else:
                end = lt
            end = page.find(">", end) if end >= 0 else -1
            if end < 0:
                return
            at = end + 1
            continue
        if lt > at:
            yield 0, "", page[at:lt]
        at, labels = m.end(), []
        while True:
            if page.startswith(">", at):
                at += 1
                break
            a = _ATTRIBUTE.match(page, at)
            at = a.end()
            if a[1]:
                break
            if at >= size:  # the tag never ends
                return
            if a[2].lower() in _LABELS:
                labels.append(a[3] or a[4] or a[5] or "")
        name = m[2].lower()
        yield (2, name, "") if m[1] else (1, name, " ".join(labels))
        if name in _RAW_END and not m[1]:
            end = _RAW_END[name].search(page, at)
            if end is None:
                return
            at = end.start()


class Element:
    __slots__ = ("name", "labels", "parent", "start", "end", "explicit")

    def __init__(self, name: str, labels: str, parent: Element | None, start: int):
        self.name, self.labels, self.parent, self.start, self.end, self.explicit = name, labels, parent, start, -1, False


def parse(page: str) -> list[tuple[int, object]]:
    """Events (0, text), (1, element), (2, element): every element starts and ends once."""
    out: list[tuple[int, object]] = []
    stack: list[Element | None] = []  # None: an inline element that ended before those inside it
    places: dict[str, list[int]] = defaultdict(list)

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close_to(place: int, explicit: bool) -> None:
        while len(stack) > place:
            e = stack.pop()
            if e is not None:
                places[e.name].pop()
                e.end, e.explicit = len(out), explicit and len(stack) == place
                out.append((2, e))

    for kind, name, data in tokens(page):
        if kind == 0:
            out.append((0, data))
        elif kind == 1:
            if name in CLOSES_P and (at := last(("p",))) > last(SCOPE):
                close_to(at, True)
            if name in CLOSES:
                scope = ("table",) if name in TABLE_PARTS else LIST_SCOPE
                places_of = [p for n in CLOSES[name] if places.get(n) and (p := places[n][-1]) > last(scope)]
                if places_of:
                    close_to(min(places_of), True)
            e = Element(name, data, stack[-1] if stack else None, len(out))
            out.append((1, e))
            if name in VOID:
                e.end, e.explicit = len(out), True
                out.append((2, e))
            else:
                places[name].append(len(stack))
                stack.append(e)
        elif name not in ("body", "html") and places.get(name):
            at = places[name][-1]
            if name in INLINE and at < len(stack) - 1:
                e = stack[at]
                places[name].pop()
                stack[at] = None
                e.end, e.explicit = len(out), True
                out.append((2, e))
            elif at >= last(("table",) if name in TABLE_PARTS else SCOPE):
                close_to(at, True)
        elif name == "p":
            out.append((0, "\n"))
    close_to(0, False)
    return out


def _never(e: Element, inside: bool) -> bool:
    """Whether the fixed names leave the element out; inside: a mark is open."""
    if e.name in NEVER or (e.name == "header" and not inside):
        return True
    if not e.labels or e.name in ("html", "body") or e.name in INLINE and e.name != "span":
        return False
    if e.name in MARKS:
        return any(BOILERPLATE.fullmatch(x) for x in e.labels.split())
    return bool(BOILERPLATE.search(e.labels) or (not inside and HEADER.search(e.labels)))


def _contexts(e: Element) -> list[str]:
    """What an element says about the words in it."""
    return [f"in {x}" for x in {*([e.name] if e.name in SPOKEN else []), *(f".{x}" for x in e.labels.lower().split())}]


class Block:
    __slots__ = ("text", "score", "gap", "mark")

    def __init__(self, text: str, score: float, gap: float, mark: Element | None):
        self.text, self.score, self.gap, self.mark = text, score, gap, mark


def walk(page: str, names: bool = True, marks: bool = True) -> Iterator[tuple[int, str, str, Element | None, tuple[str, ...]]]:
    """(kind, name, text, outermost mark, contexts): what may be content, in page order.

    Left-out elements appear as one start tag each; scripts and their like not at all.
    """
    events = parse(page)
    open_marks: dict[int, Element] = {}
    cut: list[Element] = []
    unseen = 0
    seen, outer = False, None  # whether there was a mark; the outermost open one
    around: Counter = Counter()
    now: tuple[str, ...] = ()
    for kind, x in events:
        if kind == 0:
            if not unseen and not cut:
                yield 0, "", x, outer, now
            continue
        if x.name in UNSEEN:
            unseen += 1 if kind == 1 else -1
            continue
        if unseen:
            continue
        is_mark = marks and x.name in MARKS
        if kind == 1:
            if names and is_mark and not seen and not _never(x, False):
                cut = [c for c in cut if c.explicit]  # they have no end tag
            if cut:
                continue
            if names and _never(x, bool(open_marks)):
                if x.end > x.start + 1:
                    cut.append(x)
                yield 1, x.name, "", outer, now
                continue
            if is_mark:
                open_marks[id(x)] = x
                seen, outer = True, outer or x
            if found := _contexts(x):
                around.update(found)
                now = tuple(sorted(around))
            yield 1, x.name, "", outer, now
        else:
            if x in cut:
                cut.remove(x)
                continue
            if cut:
                continue
            mark = outer
            if open_marks.pop(id(x), None) and x is outer:
                outer = next(iter(open_marks.values()), None)
            if found := [c for c in _contexts(x) if around[c]]:
                around.subtract(found)
                around += Counter()
                now = tuple(sorted(around))
            if x.name not in VOID:
                yield 2, x.name, "", mark, now


def _feature(kind: int, name: str) -> str:
    return name if name in INLINE or kind == 1 else f"/{name}"


def count_page(page: str) -> Counter:
    """How often tags, words and words by context stand inside and outside of a page's marks."""
    out: Counter = Counter()
    rows = list(walk(page, names=False))
    if any(mark is not None for *_, mark, _ in rows):
        for kind, name, text, mark, around in rows:
            inside = mark is not None
            if kind == 0:
                n = len(text.split())
                out["word", inside] += n
                for c in around:
                    out[c, inside] += n
            elif name not in MARKS:
                out[_feature(kind, name), inside] += 1
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds: of a word by itself 0.5 to 3, of a context -3 to 3, of a tag -1.5 words to -0.1; -0.25 words of a tag not counted."""
    def odds(f: str, inside: float, outside: float) -> float:
        return math.log((counts.get((f, True), 0) + 0.5) / (inside + 1.0)) - math.log((counts.get((f, False), 0) + 0.5) / (outside + 1.0))

    words = {b: counts.get(("word", b), 0) for b in (True, False)}
    tokens = {b: sum(n for (f, x), n in counts.items() if x is b and not f.startswith("in ")) for b in (True, False)}
    word = min(max(odds("word", tokens[True], tokens[False]), 0.5), 3.0) if counts else 1.0
    out = {"word": word, "other tag": -0.25 * word, "outside": min(-0.1, max(-3.0, math.log((words[False] + 0.5) / (words[True] + words[False] + 1.0)) - word))}
    for f in {f for f, _ in counts} - {"word"}:
        out[f] = min(max(odds(f, words[True], words[False]), -3.0), 3.0) if f.startswith("in ") else max(min(odds(f, tokens[True], tokens[False]), -0.1), -1.5 * word)
    return out


def best_run(scores: list[float], gaps: list[float]) -> tuple[int, int]:
    """The run [a, b) of blocks with the highest sum of scores and of the gaps between them; empty if none is positive."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for i, (s, g) in enumerate(zip(scores, gaps, strict=True)):
        run += g
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best:
            best, span = run, (begin, i + 1)
    return span


def blocks(page: str, weights: dict[str, float], names: bool = True, marks: bool = True) -> list[Block]:
    """The page's blocks with their scores and the cost of the tags before each."""
    rows = list(walk(page, names, marks))
    marked = any(mark is not None for *_, mark, _ in rows)
    word, other = weights["word"], weights["other tag"]
    out: list[Block] = []
    part: list[str] = []
    score = cost = 0.0
    inside: Element | None = None
    for kind, name, text, mark, around in [*rows, (2, "body", "", None, ())]:
        if kind == 0:
            part.append(html_lib.unescape(text))
            inside = mark
            weight = word if mark is not None else weights["outside"] if marked else max(-3.0, min(3.0, word + sum(weights.get(c, 0.0) for c in around)))
            score += weight * len(text.split())
        elif name in INLINE:
            score += weights.get(name, other)
        else:
            if joined := " ".join("".join(part).split()):
                out.append(Block(joined, score, cost, inside))
                cost = 0.0
            part, score = [], 0.0
            cost += weights.get(_feature(kind, name), other)
    return out


def extract(page: str, weights: dict[str, float], names: bool = True, marks: bool = True) -> str:
    """The main text: the best run of blocks."""
    found = blocks(page, weights, names, marks)
    if any(b.mark is not None for b in found):
        # between marks of one parent nothing scores: they are one story
        rows: list[Block] = []
        held: list[Block] = []
        last: Element | None = None
        for b in found:
            if b.mark is None:
                held.append(b)
                continue
            if last is not None and b.mark is not last and b.mark.parent is last.parent:
                b.gap = 0.0
            else:
                rows += held
            held, last = [], b.mark
            rows.append(b)
        found = rows + held
    a, b = best_run([x.score for x in found], [x.gap for x in found])
    if a == b and found:  # no run is positive: the best single block, of marked ones if there are any
        a = max(range(len(found)), key=lambda i: (found[i].mark is not None, found[i].score, -i))
        b = a + 1
    if any(x.mark is not None for x in found[a:b]):  # whole marks, and nothing else
        whole = {id(x.mark) for x in found[a:b] if x.mark is not None}
        parents = {id(x.mark.parent) for x in found[a:b] if x.mark is not None}
        return " ".join(x.text for x in found if x.mark is not None and (id(x.mark) in whole or id(x.mark.parent) in parents))
    return " ".join(x.text for x in found[a:b])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most limit ids of pages that mark their content."""
    ids = pages.where(F.col(html_col).rlike(r"(?i)<(?:article|main)[\s/>]")).select(F.col(id_col).alias("i"))
    ids = ids.where(F.col("i").isNotNull()).distinct().orderBy(F.xxhash64("i"), "i").limit(limit)  # bounded
    chosen = [r.i for r in ids.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches, "html", 4 << 20):
            for page in b.column("html").to_pylist():
                total += count_page(page or "")
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["f", "inside", "n"])

    if not chosen:
        return weights_of({})
    got = bounded_batches(pages).where(F.col(id_col).isin(chosen)).select(F.col(html_col).alias("html")).mapInArrow(run, "f string, inside boolean, n long")
    return weights_of({(r.f, r.inside): r.n for r in got.groupBy("f", "inside").agg(F.sum("n").alias("n")).collect()})


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True, marks: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    weights = fit(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            out = [extract(page or "", weights, names, marks) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = bounded_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
