"""HTML extraction by tree scoring.

Paragraphs pass points (one, one for each comma, up to three for length) to their ancestors: all of them to the parent,
half to the grandparent, a share that falls with the distance to those above. A container's points are discounted by its link
density. The best container, raised to the article around it, and its siblings with enough points are kept. Without an article around it,
it is raised to the common ancestor of all paragraphs with points and few links; there, and beside it, only what is mostly links goes.

Left out first: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by
element, role, or a word of class or id. A header inside an article stays: it holds its title. Words of class and id alone do not drop
the article, nor the greater part of the page's points, unless they mark remarks, teasers or adverts; where nothing is left they do not count.
A form around the article, or without an article around the greater part of the points, is the page's and stays; its fields go.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space. Line breaks are white space. No paragraph long enough for points: the first article, else the body, is kept.

Defined cases: null and empty pages give the empty text. Open comments and scripts run to the end of the page. Elements left open end with
their container; ends without a start are ignored. Depth costs no recursion. Pages are read one by one, so ties and repeated rows
do not matter: of equal containers the first wins. Extra columns pass through; columns named like the new ones are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td dd li div section article main figcaption".split())
DROPPED = frozenset(
    "head nav footer aside script style noscript template iframe button select textarea input svg canvas object menu dialog title "
    "noembed noframes audio video label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id values that mark what is no article text.
UNLIKELY = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies "
    "sidebar related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation topnav footer pagination pager widget "
    "toolbar skip masthead".split())
#: Of these, what may outweigh the article without being it.
APART = frozenset(
    "comment comments commentlist disqus respond replies related recommended ad ads adbox advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr popup newsletter subscribe subscription".split())
#: A class name with one of these tells how the page is laid out (has-sidebar, nav-open), not what the element is.
STATES = frozenset("has no not with without open opened closed is show hide enabled disabled layout".split())
HEADERS = frozenset("header masthead topbar".split())
#: A start tag of the key ends open elements of the value, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_ENDS_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
_STOPS_P = frozenset("article aside body button caption div footer form header html li main nav section table td th".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SHORT, NEAR, LINKED = 25, 0.2, 0.25
#: From so many levels above a paragraph on its points are passed up together with those of others, so that deep pages take linear time.
FAR = 32


class Page:
    """The elements of a page in page order, and its text: events (element, text), where None ends a block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.linked = ["#page"], [-1], [False], [False]
        self.marks: dict[int, set[str]] = {}  # elements with unlikely words, not out yet
        self.first, self.last = [0], [0]
        self.events: list[tuple[int, str | None]] = []
        self.article = [False]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of each tag
        self.open["#page"].append(0)
        stack, at, n = [0], 0, len(html)
        for found in iter(lambda: _TAG.search(html, at), None):
            if found.start() > at:
                self.events.append((stack[-1], html[at : found.start()]))
            at = found.end()
            close, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            if close:
                if self.open[name]:
                    self._end(stack, {name}, frozenset())
                continue
            if name in ENDS:
                self._end_all(stack, *ENDS[name])
            elif name in _ENDS_P:
                self._end(stack, {"p"}, _STOPS_P)
            self._start(stack, name, attributes)
            if name in VOID:
                self._pop(stack)
            elif name in RAW:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                at = n if stop is None else stop.start()
        if at < n:
            self.events.append((stack[-1], html[at:]))
        while stack:
            self._pop(stack)

    def _start(self, stack, name, attributes):
        up = stack[-1]
        inside = self.article[up] or name in ("article", "main")
        self.tag.append(name)
        self.parent.append(up)
        out, words = self._unlikely(name, attributes, self.article[up])
        self.out.append(self.out[up] or out)
        if words and not self.out[-1]:
            self.marks[len(self.out) - 1] = words
        self.linked.append(self.linked[up] or name == "a")
        self.article.append(inside)
        self.open[name].append(len(stack))
        stack.append(len(self.tag) - 1)
        if name in BLOCK:
            self.events.append((stack[-1], None))
        elif name == "br":
            self.events.append((stack[-1], " "))
        self.first.append(len(self.events))
        self.last.append(0)

    def _pop(self, stack):
        node = stack.pop()
        self.open[self.tag[node]].pop()
        self.last[node] = len(self.events)
        if self.tag[node] in BLOCK:
            self.events.append((node, None))

    def _end(self, stack, names, stops):
        """Ends the nearest open element of ``names``, unless one of ``stops`` is nearer."""
        k = max((self.open[t][-1] for t in names if self.open[t]), default=0)
        if not k or any(self.open[t] and self.open[t][-1] > k for t in stops):
            return False
        while len(stack) > k:
            self._pop(stack)
        return True

    def _end_all(self, stack, names, stops):
        while self._end(stack, names, stops):
            pass

    @staticmethod
    def _unlikely(name, attributes, in_article):
        """Whether element, role or style drop it, and the words of class and id that speak against it."""
        if name in DROPPED or name == "header" and not in_article:
            return True, None
        if name == "form":  # some hold the whole page: told by what is in them
            out, words = Page._unlikely("div", attributes, in_article)
            return out, None if out else (words or set()) | {"form"}
        if not attributes.strip() or name in ("html", "body", "article", "main", "br", "hr", "img"):
            return False, None
        values = {}
        for key, *value in _ATTRIBUTE.findall(attributes):
            values.setdefault(key.lower(), "".join(value))
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style or values.get("role", "").lower() in ROLES:
            return True, None
        words = set()
        for given in f"{values.get('class', '')} {values.get('id', '')}".split():
            found = {w.lower() for w in _WORD.findall(given)}
            if not found & STATES:
                words |= found & UNLIKELY if in_article else found & (UNLIKELY | HEADERS)
        return False, words


def _squeezed(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _spread(page: Page, marked: set[int]) -> None:
    """Takes the marked elements, with all they hold, out of the page."""
    if marked:
        for k in range(1, len(page.tag)):
            page.out[k] = page.out[k] or k in marked or page.out[page.parent[k]]


def _doubtful(page: Page) -> set[int]:
    """The elements that the words of class and id take out."""
    n = len(page.tag)
    paragraph = _paragraphs(page)[0]
    held = [paragraph.get(k, 0.0) for k in range(n)]
    for k in range(n - 1, 0, -1):
        held[page.parent[k]] += held[k]
    named, plain = [k for k in range(1, n) if page.tag[k] in ("article", "main") and not page.out[k]], [True]
    for k in range(1, n):
        plain.append(plain[page.parent[k]] and k not in page.marks)
    spared = set()
    if not any(plain[k] and any(t and t.strip() for _, t in page.events[page.first[k] : page.last[k]]) for k in named):
        spared = {k for k, words in page.marks.items() if 2 * held[k] > held[0] and not words & APART}
    around, apart = [0], [False]  # marked elements around each element, itself included, and whether one has a word of APART
    for k in range(1, n):
        marked = k in page.marks and k not in spared
        around.append(around[page.parent[k]] + marked)
        apart.append(apart[page.parent[k]] or marked and bool(page.marks[k] & APART))
    articles = [k for k in named if held[k] and not apart[k]]
    # articles that the fewest of them surround, if these outweigh what no word speaks against
    least = min((around[k] for k in articles), default=0)
    first = [k for k in articles if around[k] == least]
    if least and max(held[k] for k in first) > sum(p for k, p in paragraph.items() if not around[k]):
        seen = {0}
        for k in first:
            while k not in seen:
                seen.add(k)
                k = page.parent[k]
        spared |= seen & page.marks.keys()
    return set(page.marks) - spared


def _text(page: Page, node: int, left: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of an element; those of ``left`` do not count, whatever they hold."""
    blocks, parts = [], []
    for at, text in page.events[page.first[node] : page.last[node]]:
        if page.out[at] or at in left:
            continue
        if text is None:
            if parts:
                blocks.append(_squeezed(parts))
                parts = []
        else:
            parts.append(text)
    blocks.append(_squeezed(parts))
    return " ".join(b for b in blocks if b)


def _paragraphs(page: Page) -> tuple[dict[int, float], list[float]]:
    """Points of each paragraph, and the share of each element's text in links."""
    n = len(page.tag)
    block = [0] * n
    for k in range(1, n):
        block[k] = k if page.tag[k] in BLOCK else block[page.parent[k]]
    own: dict[int, list[str]] = {}
    size, links = [0] * n, [0] * n
    for at, text in page.events:
        if text is not None and not page.out[at]:
            own.setdefault(block[at], []).append(text)
            length = len(text.strip())
            size[at] += length
            links[at] += length if page.linked[at] else 0
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        links[page.parent[k]] += links[k]
    scores = {}
    for k, parts in own.items():
        text = _squeezed(parts)
        if page.tag[k] not in PARAGRAPH or len(text) < SHORT:
            continue
        scores[k] = (1 + text.count(",") + text.count("、") + min(3, len(text) // 100)) * (1 - links[k] / max(1, size[k]))
    return scores, [links[k] / size[k] if size[k] else 0.0 for k in range(n)]


def _points(page: Page, paragraph: dict[int, float]) -> list[float]:
    """Points of each element."""
    points, far = [0.0] * len(page.tag), [0.0] * len(page.tag)
    for k, score in paragraph.items():
        up = page.parent[k] if page.tag[k] in ("p", "pre", "blockquote", "td", "dd", "li", "figcaption") else k
        level = 0
        while up > 0:
            points[up] += score if level == 0 else score / 2 if level == 1 else score / (3 * level)
            up, level = page.parent[up], level + 1
            if level == FAR:
                far[up] += score / (3 * FAR)
                break
    for k in range(len(far) - 1, 0, -1):
        points[k] += far[k]
        far[page.parent[k]] += far[k] * FAR / (FAR + 1)
    return points


def _raised(page: Page, best: int, paragraph: dict[int, float], density: list[float]) -> str:
    """Text of the sections around and beside the best container, without what is mostly links."""
    sound = {k for k, p in paragraph.items() if p > 0 and density[k] < LINKED}
    holds = set()  # elements around such paragraphs
    for k in sound:
        while k >= 0 and k not in holds:
            holds.add(k)
            k = page.parent[k]
    top, first, last = best, min((page.first[k] for k in sound), default=page.first[best]), max((page.last[k] for k in sound), default=0)
    while top > 0 and not (page.first[top] <= first and last <= page.last[top]):
        top = page.parent[top]
    up = top if top <= 0 or page.tag[top] in ("body", "html") else page.parent[top]
    whole, left = [False] * len(page.tag), set()
    for k in range(1, len(page.tag)):
        whole[k] = k == best or whole[page.parent[k]]
        if page.parent[k] in left:
            left.add(k)
        elif not whole[k] and k not in holds and page.tag[k] in BLOCK and density[k] >= LINKED:
            left.add(k)
    return _text(page, up, left)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    if page.marks:
        before = list(page.out)
        doubtful = _doubtful(page)
        _spread(page, doubtful)
        text = _main(page)
        if len(text) >= SHORT or text and any(t in ("article", "main") and not out for t, out in zip(page.tag, page.out)):
            return text
        page.out = before
        _spread(page, {k for k, words in page.marks.items() if text and words & APART or k in doubtful and "form" in words})
        again = _main(page)
        return again if len(again) >= SHORT else text or again
    return _main(page)


def _main(page: Page) -> str:
    paragraph, density = _paragraphs(page)
    points = _points(page, paragraph)
    score = [p * (1 - d) for p, d in zip(points, density)]
    kept = [k for k in range(1, len(score)) if not page.out[k]]
    best = max(kept, key=lambda k: (score[k], -k), default=0)
    if not best or not score[best]:
        best = next((k for k in kept if page.tag[k] in ("article", "main")), next((k for k in kept if page.tag[k] == "body"), 0))
        return _text(page, best)
    top = best
    while top > 0 and page.tag[top] not in ("article", "main"):
        top = page.parent[top]
    if top <= 0:
        return _raised(page, best, paragraph, density)
    best = top
    up, texts = page.parent[best], []
    for k in kept:
        if page.parent[k] != up:
            continue
        near = score[k] >= max(10, NEAR * score[best])
        if not near and k != best and page.tag[k] in ("p", "pre", "blockquote") and density[k] < 0.25:
            near = len(_text(page, k)) > 80
        title = k < best and page.tag[k] in ("h1", "h2") and density[k] < 0.25
        if k == best or near or title:
            texts.append(_text(page, k))
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without their html, with text and n_chars (its code points)."""
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c == html or c.lower() not in ("text", "n_chars")])
    keep = [f for f in pages.schema.fields if f.name != html]
    schema = StructType([*keep, StructField("text", StringType()), StructField("n_chars", LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*[f.name for f in keep], "text", "n_chars"])

    return pages.mapInArrow(extracted, schema)
