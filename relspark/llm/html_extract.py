"""Main text of HTML pages by line-block distribution (operator 1).

Markup is stripped into lines, one for each block element.  A line weighs the length of its text outside links, less
where elements, roles, classes or ids say that it is furniture (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments): such lines weigh nothing, unless the furniture so marked holds far more of the page's text
than all else does, as then the mark is wrong.  Sums of weights over sliding windows of lines give the distribution of
text along the page; its surge and dive points, relative to its peak, bound the text.

The ends are then moved to what lies there: outwards over short lines with no furniture between, and, where marked
articles hold most of the weight found, to the ends of the articles; elsewhere no text comes before the headline.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import small_batches

# Element and attribute names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template title textarea iframe object svg math canvas audio video select button".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME = frozenset("nav footer aside form menu dialog fieldset header".split())
#: Words that speak for the text, next to which a word of _CHROME_WORDS says nothing ("post-header").
_TEXT_WORDS = frozenset("post article entry story content body text main headline title page".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond widget pagination "
    "pager toolbar toc skip".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}


@dataclass
class Line:
    text: str
    linked: int
    marks: tuple[int, ...]  # numbers of the furniture elements around it, from the outermost
    article: int  # number of the outermost article around it, or else of the main element; 0 if there is none
    headline: bool

    @property
    def mass(self) -> int:
        return max(len(self.text) - 2 * self.linked, 0)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _furniture(tag: str, source: str, in_article: bool) -> str:
    """What speaks for furniture: "hidden", "element", "word" or nothing."""
    a = _attributes(source) if source else {}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return "hidden"
    if tag in _CHROME and not (tag == "header" and in_article) or a.get("role", "").lower() in _CHROME_ROLES:
        return "element"
    if tag in ("html", "body", "main") or tag == "article" and "comment" not in source:
        return ""
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", token))}
        if words & _CHROME_WORDS and not (words & _TEXT_WORDS and words & _CHROME_WORDS <= {"header", "head"}):
            return "word"
    return ""


def lines_of(html: str) -> tuple[list[Line], dict[int, str], str]:
    """The page's blocks in order, empty ones left out; what each furniture element was told by; the page's title."""
    out: list[Line] = []
    told: dict[int, str] = {}
    stack: list[tuple[str, int]] = []  # tag, number if furniture
    parts: list[str] = []
    articles: list[int] = []
    counts = {"article": 0, "main": 0, "a": 0, "h1": 0}
    number = linked = 0
    title = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Line(text, min(linked, len(text)), tuple(n for _, n in stack if n), articles[0] if articles else 0, counts["h1"] > 0))
        linked = 0

    def pop() -> None:
        tag, _ = stack.pop()
        if tag in counts:
            counts[tag] -= 1
        if tag in ("article", "main"):
            articles.pop()

    def text(part: str) -> None:
        nonlocal linked
        if part:
            parts.append(part)
            if counts["a"]:
                linked += len(" ".join(part.split()))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            # an open paragraph or list item ends where the next block begins
            if stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                pop()
            elif tag == "p" and any(t == "p" for t, _ in stack):
                k = max(i for i, (t, _) in enumerate(stack) if t == "p")
                if not any(t in _BLOCK for t, _ in stack[k + 1 :]):
                    while len(stack) > k:
                        pop()
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = _END[tag].search(html, at)
                if tag == "title" and not title:
                    title = " ".join(unescape(html[at : end.start() if end else n]).split())
                # an unclosed one swallows the rest, as in a browser; svg and the like only where they close
                at = end.end() if end else n if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        why = _furniture(tag, m[3], counts["article"] + counts["main"] > 0)
        number += 1
        stack.append((tag, number if why else 0))
        if why:
            told[number] = why
        if tag in counts:
            counts[tag] += 1
        if tag in ("article", "main"):
            articles.append(number)
    flush()
    return out, told, title


def _blocked(lines: list[Line], told: dict[int, str]) -> set[int]:
    """Furniture elements whose mark stands.  A mark is lifted while its element would bring the page several times the
    text that it has without, more times for an element that is furniture by its name, and where an article has text."""
    stands = set(told)
    within = {m for x in lines if x.article for m in x.marks}
    while True:
        have = in_article = 0
        brings: dict[int, int] = {}
        for x in lines:
            marks = [m for m in x.marks if m in stands]
            if not marks:
                have += x.mass
                in_article += x.mass if x.article else 0
            elif len(marks) == 1:
                brings[marks[0]] = brings.get(marks[0], 0) + x.mass
            else:
                # below several marks: what the outermost lifted would not bring yet counts for it by half
                brings[marks[0]] = brings.get(marks[0], 0) + x.mass // 2
        lift = 0
        for m, mass in brings.items():
            times, least = (3, 200) if told[m] == "word" else (8, 400)
            if in_article and m not in within:
                times *= 4
            if told[m] != "hidden" and mass >= max(times * have, least) and mass > brings.get(lift, 0):
                lift = m
        if not lift:
            return stands
        stands.discard(lift)


def _between(weights: list[float], walls: list[bool], window: int, surge: float, dive: float) -> tuple[int, int]:
    """First surge and last dive: (begin, end), empty if the page never surges.  No window reaches over a wall."""
    n = len(weights)

    def ahead(i: int) -> float:
        total = 0.0
        for j in range(i, min(i + window, n)):
            if walls[j]:
                break
            total += weights[j]
        return total

    def back(i: int) -> float:
        total = 0.0
        for j in range(i, max(i - window, -1), -1):
            if walls[j]:
                break
            total += weights[j]
        return total

    begin = next((i for i in range(n) if weights[i] > 0 and ahead(i) >= surge), n)
    end = next((i + 1 for i in range(n - 1, begin - 1, -1) if weights[i] > 0 and back(i) >= dive), begin)
    return begin, end


def main_text(html: str | None, window: int = 3, surge: float = 0.2, dive: float = 0.1) -> str:
    """The article of one page: its blocks, white space squeezed, joined by \n; "" for null or no text.

    surge, dive: shares of the greatest sum of a window's weights.
    """
    lines, told, title = lines_of(html) if html else ([], {}, "")
    stands = _blocked(lines, told)
    # menus without a mark: lines of links
    own = [not any(m in stands for m in x.marks) and x.linked * 2 <= len(x.text) for x in lines]
    weights = [float(x.mass) if ok else 0.0 for x, ok in zip(lines, own)]
    peak = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0.0)
    walls = [any(m in stands and told[m] == "element" for m in x.marks) for x in lines]
    begin, end = _between(weights, walls, window, max(surge * peak, 1.0), max(dive * peak, 1.0))
    if begin >= end:
        return ""
    while begin and own[begin - 1]:
        begin -= 1
    while end < len(lines) and own[end]:
        end += 1
    kept = range(begin, end)
    by_article: dict[int, float] = {}
    for i in kept:
        by_article[lines[i].article] = by_article.get(lines[i].article, 0.0) + weights[i]
    marked = {a: w for a, w in by_article.items() if a}
    if 2 * sum(marked.values()) >= sum(by_article.values()):
        # links in an article's lines are part of it; a far smaller article beside is a teaser
        most = max(marked.values())
        some = {a for a, w in marked.items() if 4 * w >= most}
        kept = [i for i, x in enumerate(lines) if x.article in some and not any(m in stands for m in x.marks)]
    else:
        heads = [i for i in kept if own[i] and lines[i].headline]
        named = [i for i in heads if title and (title.startswith(lines[i].text[: len(title)]) or lines[i].text in title)]
        heads = named or [i for i in heads if sum(weights[begin:i]) <= sum(weights[i:end])]
        kept = [i for i in range(heads[0] if heads else begin, end) if own[i]]
    return "\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (string, never null) and n_chars (long, code points) added, html left out.

    Null, empty and unparsable html give an empty text.  Repeated rows are kept; columns of these two names are replaced.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch[html]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*kept, html).mapInArrow(rows, schema)
