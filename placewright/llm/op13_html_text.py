"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a row of tokens: words, which score positive, and tags, which score negative. The contiguous row of tokens with the highest
sum, found by one linear scan, is the content; its text is that of the blocks it touches.

Weights come from labelled pages: those that mark their article with an `article` or `main` element. A word's weight is the
share of words in its place that are content; places are told by whether the word is in a link and whether it is within the mark,
beside it, or on a page without one (for which the labelled pages are counted with their marks hidden). A tag's is the share of
such tags that aren't content, times a cost: within and beside a mark all tags are alike, on pages without one they differ by name.
The cost is chosen for the best F1 on the labelled pages with their marks hidden. Weights
start from prior counts, so a table without labelled pages works too. About SAMPLE labelled pages are learned from, chosen by a hash.

What is never content isn't scored: elements such as scripts, menus, forms and footers, and those whose class, id or role says
that they are adverts, notices, sidebars or reader comments. Such an element within the article doesn't end it. An element whose class
says so but which holds the article is kept. If nothing is left (a menu that is never closed, say), elements that aren't closed are kept.

Text: character references are decoded, white space within a block becomes one space, blocks are joined by one space; inline tags add
nothing, a line break is white space.

Defined results: null and empty pages, and pages without words, have an empty text; a page may end anywhere, also within a tag
(which is dropped) or a comment; end tags without a start are ignored; long pages are read whole, in time linear in their length;
repeated rows are given each; ties among regions go to the first; page_id and url are passed on as they are, null too; other columns
aren't read; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, small_batches, table

#: Labelled pages that weights are learned from, about.
SAMPLE = 2000
#: Costs of a tag that are tried; the first is taken where no page is labelled.
COSTS = (3.25, 0.5, 1.0, 2.0, 5.0, 8.0, 12.0)
#: Tokens that the priors count as, and the shares of content they hold: of words and words in links by place, of tags of running text and of other tags.
PRIOR = 20.0
PRIOR_SHARES = {"word within": 0.99, "word beside": 0.05, "word unmarked": 0.9, "link within": 0.9, "link beside": 0.02, "link unmarked": 0.3, "tag within": 0.99, "tag beside": 0.05, "text tag": 0.8, "tag": 0.4}
#: What a word scores at least.
LEAST = 0.001

# Names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never content.
DROPPED = frozenset("head script style title noscript template iframe noembed noframes object svg math canvas audio video map nav footer aside form fieldset button select textarea input label datalist dialog menu search".split())
#: Roles of elements that aren't content.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that say an element isn't content; the first are of reader comments.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
HINTS = COMMENTS | frozenset(
    "ad ads alert alerts adsense advert advertisement advertisements adverts banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup popover promo promoted promotion recommended recommendations related search share sharebar sharing sidebar signup skip skyscraper social sponsor sponsored sponsors subscribe subscription toc toolbar topbar widget widgets".split()
)
#: A header is content's own where one of these stands beside it; these prefixes say that an element has or lacks something, not that it is it.
OWN = frozenset("article content entry post story".split())
PREFIXES = frozenset("has with no without is not".split())
MARKS = frozenset(["article", "main"])
TEXT_TAGS = INLINE | frozenset("p br h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+(>|\Z))|<[!?/](?!\Z)[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: An open element of these ends where one of the same kind begins.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def not_content(name: str, attributes: str) -> str:
    """Why an element isn't content: `drop` by its name, `comment` or `hint` by its attributes; else an empty string."""
    if name in DROPPED:
        return "drop"
    if not attributes or name in ("html", "body"):
        return ""
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "").lower()):
        return "drop"
    if found.get("role", "").lower() in ROLES:
        return "drop"
    why = ""
    for label in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in _PARTS.findall(label)]
        if not parts or parts[0] in PREFIXES:
            continue
        if not COMMENTS.isdisjoint(parts):
            return "comment"
        if not HINTS.isdisjoint(parts) or ("header" in parts and OWN.isdisjoint(parts)):
            why = "hint"
    return "" if name in MARKS else why


@dataclass
class Page:
    """Blocks of text and tokens: (block, words, in a link, within the mark) of a run of words, (-1, name, closing, within the mark) of a tag."""

    blocks: list[list[str]] = field(default_factory=lambda: [[]])
    tokens: list[tuple] = field(default_factory=list)
    marked: bool = False


@dataclass
class Element:
    start: int
    name: str
    why: str  # why it isn't content
    tags: int = 0  # its tags are those from start up to here
    runs: int = 0  # the runs of text within it are those before the tags after start, up to this one
    closed: bool = False


def parsed(source: str) -> Page:
    """The page without what is never content."""
    tags, elements = _elements(source)
    page = _content(source, tags, elements, False)
    return page if any(t[0] >= 0 for t in page.tokens) else _content(source, tags, elements, True)


def _elements(source: str) -> tuple[list[tuple[int, int, str, bool, bool]], list[Element]]:
    """The tags of a page, (from, until, name, closing, link), and its elements."""
    tags: list[tuple[int, int, str, bool, bool]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    names: Counter = Counter()
    at = 0

    def pop(tags_until: int, runs_until: int, closed: bool) -> None:
        e = stack.pop()
        names[e.name] -= 1
        e.tags, e.runs, e.closed = tags_until, runs_until, closed
        elements.append(e)

    while (m := _TOKEN.search(source, at)) is not None:
        at, name = m.end(), (m[2] or "").lower()
        if m[4] == "":
            name = ""  # the page ends within this tag
        attributes, n = m[3] or "", len(tags)
        tags.append((m.start(), at, name, bool(m[1]), name == "a" and "href" in attributes.lower()))
        if not name:
            continue
        if m[1]:
            if names[name]:
                while stack[-1].name != name:
                    pop(n, n, False)
                pop(n + 1, n, True)
            continue
        while stack and stack[-1].name in _ENDS.get(name, ()):
            pop(n, n, True)
        e = Element(n, name, not_content(name, attributes))
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS | RAW | INLINE):
            e.tags, e.runs, e.closed = n + 1, n, True
            elements.append(e)
            continue
        stack.append(e)
        names[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end.start() if end else len(source)
    while stack:
        pop(len(tags), len(tags), False)
    return tags, elements


def _covered(size: int, spans: list[tuple[int, int]]) -> list[bool]:
    """Which of the numbers up to size lie in a span (from, until)."""
    steps, depth, out = [0] * (size + 1), 0, []
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    for d in steps[:size]:
        depth += d
        out.append(depth > 0)
    return out


def _content(source: str, tags: list, elements: list[Element], lenient: bool) -> Page:
    size = len(tags) + 1
    own = [e for e in elements if e.name in MARKS and not e.why]
    starts = sorted(e.start for e in own)
    within_own = _covered(size, [(e.start, e.tags) for e in own])

    def holds(e: Element) -> bool:
        i = bisect_right(starts, e.start)
        return i < len(starts) and starts[i] < e.tags

    def dropped(e: Element) -> bool:
        if lenient and not e.closed and e.name not in RAW:
            return False
        if e.why:
            return e.why != "hint" or not holds(e)
        return e.name == "header" and not within_own[e.start] and not holds(e)  # of the page, not of an article

    gone = [e for e in elements if dropped(e)]
    hidden, silent = _covered(size, [(e.start, e.tags) for e in gone]), _covered(size + 1, [(e.start + 1, e.runs + 1) for e in gone])
    marks = [e for e in own if e.name == "article" and not hidden[e.start]] or [e for e in own if not hidden[e.start]]
    inner, spoken = _covered(size, [(e.start + 1, max(e.start + 1, e.runs)) for e in marks]), _covered(size + 1, [(e.start + 1, e.runs + 1) for e in marks])

    page, at, link = Page(marked=bool(marks)), 0, False
    for n, (start, end, name, closing, starts_link) in enumerate([*tags, (len(source), len(source), "", False, False)]):
        if start > at and not silent[n]:
            text = html.unescape(source[at:start])
            words = len(text.split())
            page.blocks[-1].append(text)
            if words:
                page.tokens.append((len(page.blocks) - 1, words, link, spoken[n]))
        at = end
        if name in BLOCKS and page.blocks[-1]:
            page.blocks.append([])
        if not name or hidden[n]:
            continue
        if name == "a":
            link = starts_link and not closing
        elif name == "br":
            page.blocks[-1].append("\n")
        page.tokens.append((-1, name if name in BLOCKS or name in INLINE or name in VOID else "other", closing, inner[n]))
    return page


def place(page: Page, within: bool, marks: bool) -> str:
    """Where a word stands: within the mark, beside it, or on a page without one."""
    return "unmarked" if not marks or not page.marked else "within" if within else "beside"


def features(page: Page, marks: bool) -> Iterator[tuple[str, int, bool]]:
    """(feature, tokens, whether they are content) of a labelled page, with its marks or without them."""
    for block, n, flag, within in page.tokens:
        if block >= 0:
            yield f"{'link' if flag else 'word'} {place(page, within, marks)}", n, within
        else:
            where = place(page, within, marks)
            yield f"{'/' if flag else ''}{n}" if where == "unmarked" else f"tag {where}", 1, within


@dataclass
class Weights:
    shares: dict[str, float]
    cost: float

    def word(self, link: bool, where: str) -> float:
        name = f"{'link' if link else 'word'} {where}"
        return max(LEAST, self.shares.get(name, PRIOR_SHARES[name]))

    def tag(self, name: str, closing: bool, where: str) -> float:
        name, prior = (f"{'/' if closing else ''}{name}", "text tag" if name in TEXT_TAGS else "tag") if where == "unmarked" else (f"tag {where}", f"tag {where}")
        return -self.cost * (1.0 - self.shares.get(name, PRIOR_SHARES[prior]))


def region(page: Page, weights: Weights, marks: bool = True) -> tuple[int, int] | None:
    """First and last token of the contiguous row with the highest sum."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, (block, n, flag, within) in enumerate(page.tokens):
        if total <= 0.0:
            total, start = 0.0, i
        where = place(page, within, marks)
        total += n * weights.word(flag, where) if block >= 0 else weights.tag(n, flag, where)
        if total > best:
            best, found = total, (start, i)
    return found


def main_text(source: str, weights: Weights) -> str:
    page = parsed(source)
    found = region(page, weights)
    if found is None:
        return ""
    touched = [t[0] for t in page.tokens[found[0] : found[1] + 1] if t[0] >= 0]
    texts = (" ".join("".join(b).split()) for b in page.blocks[touched[0] : touched[-1] + 1])
    return " ".join(t for t in texts if t)


def _rates(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Shares of content, with prior counts."""
    out = {}
    for name in {k for k, _ in counts}:
        inside, outside = counts.get((name, True), 0), counts.get((name, False), 0)
        kind = name if " " in name else "text tag" if name.lstrip("/") in TEXT_TAGS else "tag"
        out[name] = (inside + PRIOR * PRIOR_SHARES[kind]) / (inside + outside + PRIOR)
    return out


def fitted(pages: DataFrame) -> Weights:
    """Weights learned from the labelled pages of a table (html)."""
    marked = pages.select("html", F.xxhash64(*[F.col(c) for c in ("page_id", "html")]).alias("_h")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    sample = marked if n <= SAMPLE else marked.where(F.pmod(F.col("_h"), F.lit(n)) < SAMPLE)
    with small_batches(pages.sparkSession):
        sample = settled(sample.select("html"), "labelled")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for source in batch.column("html").to_pylist():
                    page = parsed(source)
                    if page.marked:
                        for marks in (True, False):
                            for name, k, inside in features(page, marks):
                                found[name, inside] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["name", "inside", "n"])

        # Names of HTML alone, so few rows.
        rows = sample.mapInArrow(count, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()
        shares = _rates({(r.name, r.inside): r.n for r in rows})

        def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right, wrong = [0] * len(COSTS), [0] * len(COSTS)
            for batch in batches:
                for source in batch.column("html").to_pylist():
                    page = parsed(source)
                    if not page.marked:
                        continue
                    for i, cost in enumerate(COSTS):
                        found = region(page, Weights(shares, cost), False) or (0, -1)
                        for j, (block, k, _, inside) in enumerate(page.tokens):
                            if block >= 0:
                                taken = found[0] <= j <= found[1]
                                right[i] += 2 * k * (inside and taken)
                                wrong[i] += k * (inside != taken)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(COSTS)), pa.int32()), pa.array(right, pa.int64()), pa.array(wrong, pa.int64())], names=["i", "matched", "missed"])

        scores = sample.mapInArrow(tried, "i int, matched long, missed long").groupBy("i").agg((F.sum("matched") / F.greatest(F.lit(1), F.sum(F.col("matched") + F.col("missed")))).alias("f1")).collect()  # a row a cost
    best = max(scores, key=lambda r: (r.f1, -r.i), default=None)
    return Weights(shares, COSTS[best.i if best is not None else 0])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    kinds = {c: pages.schema[c].dataType for c in ("page_id", "url")}
    form = T.StructType([*[T.StructField(c, k) for c, k in kinds.items()], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, weights) if source else "" for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in form])

    with small_batches(pages.sparkSession):
        return settled(pages.select("page_id", "url", "html").mapInArrow(run, form), "texts")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fitted(pages))


#: The articles of these tables by their marks: each page has one, of headings and paragraphs.
ORACLE = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS inner_html FROM pages),
parts AS (SELECT page_id, url, list_transform(string_split_regex(inner_html, '</?(h1|p)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM articles),
decoded AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM parts)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS text, CAST(length(array_to_string(list_filter(parts, lambda x: x <> ''), ' ')) AS BIGINT) AS n_chars FROM decoded
"""
