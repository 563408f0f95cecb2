"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of text runs and tags. Each word scores by its context (its nearest block element, on pages with an article or
main element with the side of it, or the boilerplate element around it), each tag by its name; both weights are log odds of lying inside the main text, counted over a bounded sample of labelled
pages, with tags held negative. One linear scan finds the contiguous region of highest total score; its blocks are the text.
Boilerplate elements neither score nor give text, so one inside the main text does not cut it. Pages are independent, so nothing but the sample's counts is shuffled."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import byte_slices, texts_of

#: Expected number of pages, drawn by a hash of their ids, of which those that mark their main text are the labelled ones.
SAMPLE_PAGES = 1000
SLICE_BYTES = 1 << 22
#: Pseudo-counts (inside, outside) of a word by the kind of its context and of a tag, before any page is seen.
WORD_PRIOR, BOILER_PRIOR, TAG_PRIOR = (3.0, 1.0), (1.0, 8.0), (1.0, 1.0)
TAG_MOST = -0.05

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^"'>]|"[^"]*"|'[^']*')*>|</?[A-Za-z][^>]*(?:>|\Z)""", re.S | re.I)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HINT_WORDS = (
    "ads? adverts? advertisements? advertising sponsor(?:ed|s)? promo(?:s|tion)? banner sidebar header footer masthead nav navbar navigation menu breadcrumbs? comments? disqus replies cookies? consent"
    " notice alert popup modal newsletter subscribe social share sharing related widgets? pagination pager login search toolbar skip contentinfo complementary"
).replace(" ", "|")
#: A whole token of a class, id or role: the words above, with words of place before and of form behind them.
BOILER_HINT = re.compile(
    rf"(?:(?:site|page|global|top|bottom|left|right|primary|secondary|user|reader|main)[-_])?(?:{HINT_WORDS})"
    rf"(?:[-_]?(?:{HINT_WORDS}|box|bar|area|list|links?|container|wrap|wrapper|section|block|unit|slot|form|thread|inner|outer|top|bottom|left|right|\d+))*",
    re.I,
)
BOILER = frozenset("head nav header footer aside form button select menu dialog title".split())
#: Elements that a hint does not make boilerplate: they hold the page, or are text themselves.
UNHINTED = frozenset("html body main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt td".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 article section header footer nav aside form blockquote pre figure main hr address fieldset".split())
SCOPE = frozenset("html body article section main div nav header footer aside form table td th ul ol".split())
MAIN = frozenset(("article", "main"))


class Cover:
    """A boilerplate element that is not inside another one: where its tag stands, its kind, its words, whether it holds the main text."""

    def __init__(self, at: int, kind: str):
        self.at, self.kind, self.words, self.holds_main = at, kind, 0, False


def tokens(html: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, value, boiler, main) of text runs and tags in page order. A text run has its context as kind, its raw text as value; a tag
    has kind "<" and its name, with / before it if it ends an element. Scripts, styles, comments and declarations give no token.

    An element is no boilerplate if an article or main element stands in it, or if only its class, id or role says so and it holds most
    words of a page that marks no main text elsewhere."""
    spared: set[int] = set()
    while True:
        covers: list[Cover] = []
        out = list(scan(html, spared, covers))
        total = sum(len(v.split()) for k, v, _, _ in out if k not in ("<", "!head", "!title"))
        marked = any(main and not boiler for _, _, boiler, main in out)
        wrong = {c.at for c in covers if c.holds_main or (c.kind == "hint" and 2 * c.words > total and not marked)}
        if not wrong:
            return out
        spared |= wrong


def hinted(name: str, raw: str, main: bool) -> bool:
    """Whether class, id or role of an element call it boilerplate; an article only inside another one."""
    if name in UNHINTED or (name == "article" and not main):
        return False
    return any(BOILER_HINT.fullmatch(t) for m in HINT.finditer(raw) for t in (m[1] or m[2] or m[3] or "").split())


def scan(html: str, spared: set[int], covers: list[Cover]) -> Iterator[tuple[str, str, bool, bool]]:
    stack: list[tuple[str, str | None, bool]] = []  # name, boilerplate kind, inside marked main text

    def state() -> tuple[str, bool, bool]:
        boiler = stack[-1][1] if stack else None
        main = stack[-1][2] if stack else False
        if boiler:
            return f"!{boiler}", True, main
        return next((n for n, _, _ in reversed(stack) if n not in INLINE), "body"), False, main

    def close(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    def run(text: str) -> tuple[str, str, bool, bool]:
        if stack and stack[-1][0] == "head" and not text.isspace():
            stack.pop()
        kind, boiler, main = state()
        if boiler:
            covers[-1].words += len(text.split())
        return kind, text, boiler, main

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield run(html[at : m.start()])
        at, raw = m.end(), m[0]
        found = None if m[1] else NAME.match(raw)
        if not found:
            continue
        name = found[1].lower()
        if raw[1] == "/":
            _, boiler, main = state()
            yield "<", "/" + name, boiler, main
            close({name}, frozenset())
            continue
        if name not in IN_HEAD:  # the end tag of head may be left out
            close({"head"}, SCOPE)
        if name in ENDS_P:
            close({"p"}, SCOPE)
        if name in CLOSES:
            close(CLOSES[name], SCOPE - CLOSES[name])
        if name not in VOID and not raw.endswith("/>"):
            kind, main = stack[-1][1:] if stack else (None, False)
            if kind and name in MAIN and not main:
                covers[-1].holds_main = True
            if not kind and m.start() not in spared:
                kind = name if name in BOILER and not (name == "header" and main) else "hint" if hinted(name, raw, main) else None
                if kind:
                    covers.append(Cover(m.start(), kind))
            stack.append((name, kind, main or name in MAIN))
        _, boiler, main = state()
        yield "<", name, boiler, main
    if at < len(html):
        yield run(html[at:])


def placed(items: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str, bool, bool]]:
    """On pages that mark their main text, contexts of text with + inside and - outside of it."""
    if not any(main and not boiler for _, _, boiler, main in items):
        return items
    return [(kind if kind == "<" or boiler else kind + "-+"[main], value, boiler, main) for kind, value, boiler, main in items]


def label_counts(html: str) -> Counter:
    """Counter of (token kind, inside 0/1) of a page that marks its main text by an article or main element; else empty."""
    seen: Counter = Counter()
    items = tokens(html)
    if not any(main and not boiler for _, _, boiler, main in items):
        return seen
    for (kind, value, boiler, main), (place, *_) in zip(items, placed(items)):
        inside = int(main and not boiler)
        if kind == "<":
            seen["<" + value.lstrip("/"), inside] += 1
        elif n := len(value.split()):
            seen[kind, inside] += n
            if place != kind:
                seen[place, inside] += n
    return seen


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weight of every token kind seen in the sample: log odds of inside against outside, priors added. The rows that reach the driver are
    as many as there are kinds of tags and contexts; the sampled pages are counted where they lie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for html in texts_of(batch.column(0)):
                total.update(label_counts(html))
            rows = [(k, n if i else 0, 0 if i else n) for (k, i), n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["kind", "inside", "outside"])

    rate = min(1.0, sample / max(1, pages.count()))
    draw = F.pmod(F.xxhash64(F.lit("label"), id_col), F.lit(1 << 30)) / float(1 << 30)
    few = pages.where((draw < rate) & F.col(html_col).rlike("(?i)<(article|main)[ >]")).select(html_col)
    rows = few.mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {r["kind"]: weight(r["kind"], r["inside"], r["outside"]) for r in rows}


def weight(kind: str, inside: float = 0, outside: float = 0) -> float:
    a, b = TAG_PRIOR if kind[0] == "<" else BOILER_PRIOR if kind[0] == "!" or kind[-1] == "-" else WORD_PRIOR
    w = math.log((inside + a) / (outside + b))
    return min(w, TAG_MOST) if kind[0] == "<" else w


def main_text(html: str, weights: dict[str, float]) -> str:
    """Text of the best region: its blocks joined by line ends."""
    items = placed(tokens(html))
    best = score = 0.0
    start, region = 0, (0, 0)
    for k, (kind, value, boiler, _) in enumerate(items):
        if boiler:
            continue
        if kind == "<":
            key = "<" + value.lstrip("/")
            score += weights[key] if key in weights else weight(key)
        elif n := len(value.split()):
            score += n * (weights[kind] if kind in weights else weight(kind))
        if score <= 0:
            score, start = 0.0, k + 1
        elif score > best:
            best, region = score, (start, k + 1)
    blocks: list[str] = []
    text: list[str] = []
    for kind, value, boiler, _ in items[region[0] : region[1]]:
        if kind == "<":
            name = value.lstrip("/")
            if name not in INLINE:
                blocks.append("".join(text))
                text = []
            elif name == "br":
                text.append(" ")
        elif not boiler:
            text.append(value)
    blocks.append("".join(text))
    return "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. Null and empty pages, and pages without a word of positive score, give the empty text.
    Repeated rows are extracted one by one; other columns are not read."""
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, {url_col} string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, html_col, SLICE_BYTES):
                out = [main_text(h, weights) for h in texts_of(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def extracted(pages: DataFrame) -> DataFrame:
    return extract(pages, learn(pages))
