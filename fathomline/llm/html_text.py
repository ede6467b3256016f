"""Main text of a page by composite text density: link-adjusted characters per tag, summed over children."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import fresh

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Never part of an article, whatever the page calls them.
NEVER = frozenset("applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input keygen map menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
#: Their content is text up to their end tag.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Words in class, id or role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disqus "
    "footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: What an element's start tag ends, and where looking for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|["'])*+""")
MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/]|$)""", re.IGNORECASE)
WORD = re.compile(r"[A-Za-z0-9]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", string, ""), ("start", name, attributes) and ("end", name, "") in page order; comments and declarations are left out."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        name = NAME.match(html, lt + 1)
        if name:
            rest = REST.match(html, name.end())
            if rest.end() == size:  # the page ends inside a tag
                return
            tag, at = name[1].lower(), rest.end() + 1
            if html[lt + 1] == "/":
                yield "end", tag, ""
                continue
            yield "start", tag, rest[0]
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = close.start() if close else size
        elif html.startswith("<!--", lt):
            end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
            at = size if end < 0 else html.find(">", end) + 1
        elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at = lt + 1


def aside(tag: str, attributes: str) -> bool:
    """Whether an element is marked as not belonging to an article."""
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in MARKS.findall(attributes):
        value = value.strip("\"'")
        if name.lower() in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                return True
        elif any(w.lower() in AROUND for w in WORD.findall(value)):
            return True
    return False


class Page:
    """Structural elements in page order (parents first) and the texts between them. Formatting tags are text, not structure."""

    def __init__(self, html: str):
        self.tags, self.parents, self.out = [""], [-1], [False]
        self.texts: list[tuple[int, str]] = []  # element and text; element -1 is the border of a block
        self._stack, self._open = [0], {"": 1}
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(value, attributes)
            else:
                self._end(value)

    def _text(self, value: str) -> None:
        if not self.out[self._stack[-1]]:
            self.texts.append((self._stack[-1], unescape(value)))

    def _border(self) -> None:
        if self.texts and self.texts[-1][0] >= 0:
            self.texts.append((-1, ""))

    def _pop(self) -> None:
        tag = self.tags[self._stack.pop()]
        self._open[tag] -= 1
        if tag in BLOCKS:
            self._border()

    def _close(self, closing: set[str], fence: set[str]) -> None:
        """Ends the outermost open element of ``closing`` above the nearest of ``fence``."""
        if not any(self._open.get(t) for t in closing):
            return
        at = found = len(self._stack)
        while at > 1 and self.tags[self._stack[at - 1]] not in fence:
            at -= 1
            if self.tags[self._stack[at]] in closing:
                found = at
        while len(self._stack) > found:
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if tag == "br":
            self._text(" ")
        if block:
            if tag not in ("head", "title", "html"):
                self._close({"head"}, set())
            self._close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "button"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "a":
            self._close({"a"}, BLOCKS)
        if block:
            self._border()
        inside = self.out[self._stack[-1]]
        away = inside or aside(tag, attributes) or (tag == "header" and not (self._open.get("article") or self._open.get("main")))
        if (not block and tag != "a" and away == inside) or tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.out.append(away)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag and self._open.get(tag):
            while self.tags[self._stack[-1]] != tag:
                self._pop()
            self._pop()

    def densities(self) -> tuple[list[float], list[float]]:
        """Each element's composite density, and the sum of its children's."""
        n = len(self.tags)
        chars, links, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.texts:
            if node >= 0:
                chars[node] += len("".join(text.split()))
        for i in range(n - 1, -1, -1):
            if self.tags[i] == "a":
                links[i] = chars[i]
            up = self.parents[i]
            if up >= 0 and not self.out[i]:
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                anchors[up] += anchors[i] + (self.tags[i] == "a")
        share = links[0] / chars[0] if chars[0] else 0.0
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if chars[i] and not self.out[i]:
                c, t, linked = chars[i], max(tags[i], 1), max(links[i], 1)
                base = log(c * linked / max(c - links[i], 1) + share * c + e)
                density[i] = c / t * log(c / linked * t / max(anchors[i], 1)) / log(base)
                if self.parents[i] >= 0:
                    sums[self.parents[i]] += density[i]
        return density, sums

    def chosen(self) -> set[int]:
        """The elements at the top of the article.

        The element whose children's densities have the largest sum is the
        core (of equal sums the outermost). Where the page has an article or
        main element around the core, or a single one inside it, that is the
        article. Otherwise elements elsewhere whose density reaches the least
        one on the way from the core up to below the body belong to it too.
        """
        density, sums = self.densities()
        core = max(range(len(sums)), key=lambda i: (not self.out[i], sums[i], -i))
        if sums[core] <= 0:
            core = max(range(len(sums)), key=lambda i: (not self.out[i], density[i], -i))
        path = [core]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        for kind in ("article", "main"):
            around = [i for i in path if self.tags[i] == kind]
            if around:
                return {around[-1]}
        inside = [False] * len(sums)
        inside[core] = True
        for i in range(core + 1, len(sums)):
            inside[i] = inside[self.parents[i]]
        for kind in ("article", "main"):
            found = [i for i in range(len(sums)) if inside[i] and self.tags[i] == kind and not self.out[i]]
            if len(found) == 1:
                return {found[0]}
        ends = [i for i in path if i and self.tags[i] not in ("html", "body")] or [core]
        least, above = min(density[i] for i in ends), set(path)
        return {core} | {i for i in range(1, len(sums)) if i not in above and not self.out[i] and density[i] > 0 and density[i] >= least}

    def text(self) -> str:
        tops = self.chosen()
        kept = [False] * len(self.tags)
        for i, up in enumerate(self.parents):
            kept[i] = not self.out[i] and (i in tops or (up >= 0 and kept[up]))
        blocks: list[str] = []
        parts: list[str] = []
        for node, text in [*self.texts, (-1, "")]:
            if node >= 0:
                if kept[node]:
                    parts.append(text)
            elif parts:
                block = " ".join("".join(parts).split())
                if block:
                    blocks.append(block)
                parts = []
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html or "").text()


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text``, the main text of each page, and ``n_chars``, its code points; earlier columns of these names are replaced.

    Scripts, styles, forms, navigation, headers and footers of the page, and
    elements whose class, id or role marks them as adverts, notices, sidebars
    or reader comments, go first; composite text density then finds the
    article (see ``Page.chosen``). White space inside a block, line breaks
    included, becomes one space; blocks without text are left out; the others
    are joined by a newline. Null, empty and textless pages give an empty text;
    tags that don't match, end early or are cut off are read as browsers do;
    pages of any length and depth are read whole in time that grows with their
    length; repeated pages are each read; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h) for h in batch.to_pylist()], pa.string())

    extract = F.arrow_udf(work, "string")
    (body,) = fresh(pages.columns, "_body")
    return pages.withColumn(body, extract(F.col(html_col))).withColumn("text", F.col(body)).withColumn("n_chars", F.length(body).cast("long")).drop(body)
