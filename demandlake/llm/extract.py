"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|xmp|noembed|svg|math)\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button select option datalist noscript template iframe object canvas dialog menu audio video svg math".split())
BLOCK = frozenset(
    "html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset figure figcaption address details summary center hr "
    "head noscript template dialog menu".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td th blockquote li dd dt figcaption caption h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"head", "html", "body"}
#: An open element of the values ends where one of the keys begins, within the nearest list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that mark what is not the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets "
    "rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus "
    "respond replies reply share sharing social related recommended recommendations outbrain taboola login search pager pagination skip "
    "form hidden print-only toc-nav tags taglist header".split()
)
GOOD_NAMES = frozenset("article content main post entry body text story page-content".split())
LEAST = 25  # characters of a paragraph that passes points on


class Page:
    """A page as flat lists: elements in page order with their parents, and blocks of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.bad, self.good = ["#root"], [0], [False], [0]
        self.holds_main = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        bad, named_bad, good = tag in DROPPED, False, 0
        if attributes and tag in BLOCK or "hidden" in attributes:
            if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes):
                bad = True
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "role":
                    bad |= value in ROLES
                    good += 25 * (value == "main")
                elif name == "style":
                    bad |= bool(HIDDEN.search(value))
                elif name == "aria-hidden":
                    bad |= value == "true"
                else:
                    words = set(re.split(r"[^a-z]+", value))
                    named_bad |= bool(words & BAD_NAMES)
                    good += 25 * bool(words & GOOD_NAMES)
        if tag in ("html", "body", "main", "a", "span"):
            named_bad = False
        if tag == "header":  # a page's header goes, an article's own keeps its headings
            named_bad = True
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.bad.append(bad or (named_bad and "named"))
        self.good.append(good + (10 if tag == "article" else 5 if tag == "main" else 0))
        self.holds_main.append(False)
        if (tag in ("main", "h1") or tag == "article" and not named_bad) and not bad:
            at = stack[-1]
            while at and not self.holds_main[at]:
                self.holds_main[at] = True
                at = self.parent[at]
            self.holds_main[n] = tag != "article" or self.holds_main[n]
        stack.append(n)

    def _parse(self, html: str) -> None:
        stack, held, linked, links = [0], [], 0, 0
        tags = self.tag

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    at = stack[-1]
                    while at and tags[at] not in BLOCK:
                        at = self.parent[at]
                    self.blocks.append((at, text, min(linked, len(text))))
                held, linked = [], 0

        def close(to: int) -> None:
            nonlocal links
            for n in stack[to:]:
                links -= tags[n] == "a"
            del stack[to:]

        for m in TOKEN.finditer(html):
            text = m[8]
            if text is not None:
                held.append(text)
                if links:
                    linked += len(text.strip())
                continue
            name = m[3] or m[6]
            if not name:
                continue
            tag, ends = name.lower(), m[2] or m[5]
            if ends:
                if tag in BLOCK:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        close(k)
                        break
                    if tag not in BLOCK and tags[stack[k]] in BLOCK:
                        break  # an inline end does not close blocks
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in BLOCK:
                        break
            if tag in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in CLOSES[tag]:
                        close(k)
                        if tag != "tr" or tags[stack[-1]] != "tr":
                            break
                    elif tags[stack[k]] in SCOPE:
                        break
            if tag == "a" and links:  # links do not nest
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "a":
                        close(k)
                        break
            attributes = (m[4] or m[7] or "").rstrip()
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            self._open(stack, tag, attributes)
            links += tag == "a"
        flush()

    def main_text(self) -> str:
        """The blocks of the best container and its siblings, in page order."""
        n = len(self.tag)
        tag, parent = self.tag, self.parent
        gone, in_article, headings_only = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            up = parent[k]
            named = self.bad[k] == "named" and not (self.holds_main[k] and tag[k] != "header")
            if tag[k] == "header" and in_article[up] and self.bad[k] == "named":
                named, headings_only[k] = False, True
            headings_only[k] = headings_only[k] or headings_only[up]
            gone[k] = gone[up] or self.bad[k] is True or named
            in_article[k] = in_article[up] or tag[k] in ("article", "main")
        chars, linked, points = [0] * n, [0] * n, [0.0] * n
        kept = []
        for at, text, link in self.blocks:
            if gone[at] or headings_only[at] and tag[at] not in HEADINGS:
                continue
            kept.append((at, text))
            up = at
            while up:
                chars[up] += len(text)
                linked[up] += link
                up = parent[up]
            if len(text) >= LEAST:
                score = 1 + text.count(",") + min(len(text) / 100, 3)
                holder = parent[at] if tag[at] in PARAGRAPH else at
                points[holder] += score
                points[parent[holder]] += score / 2
                points[parent[parent[holder]]] += score / 4
        if not kept:
            return ""
        density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
        # Lists of links are menus wherever they stand.
        for k in range(1, n):
            gone[k] = gone[parent[k]] or (tag[k] in ("ul", "ol", "div", "section", "table") and density[k] >= 0.8)
        kept = [(at, text) for at, text in kept if not gone[at]]
        score = [(points[k] + (self.good[k] if points[k] else 0)) * (1 - density[k]) for k in range(n)]
        semantic = [k for k in range(1, n) if tag[k] in ("article", "main") and chars[k] and not gone[k]]
        inside = [False] * n
        for k in range(1, n):
            inside[k] = inside[parent[k]] or tag[k] in ("article", "main")
        pool = [k for k in range(1, n) if not gone[k] and points[k] > 0 and (inside[k] or not semantic)]
        best = max(pool, key=lambda k: (score[k], -k)) if pool else (semantic[0] if semantic else 0)
        up = best
        while up and tag[up] not in ("article", "main"):
            up = parent[up]
        if up:
            chosen = {up}
        elif best:
            chosen = {best}
            for k in range(1, n):
                if parent[k] == parent[best] and not gone[k] and k != best:
                    paragraph = tag[k] in PARAGRAPH and density[k] < 0.25 and (chars[k] > 80 or tag[k] in HEADINGS)
                    if paragraph or score[k] >= max(10.0, 0.2 * score[best]):
                        chosen.add(k)
        else:
            chosen = {0}
        within = [False] * n
        for k in range(n):
            within[k] = k in chosen or (k > 0 and within[parent[k]])
        return "\n".join(text for at, text in kept if within[at])


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if there is none."""
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Pages with ``text`` and ``n_chars`` (code points), without the html.

    The whole html is read. Null or empty html, and a page without text outside menus and the
    like, give an empty text. Broken markup is read on as browsers do: an open paragraph ends
    where a block begins, an unclosed element ends with the one around it. Rows stay as many
    as they are; columns of those two names are replaced, others pass.
    """
    rest = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    schema = StructType([*rest, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [f.name for f in schema],
            )

    return pages.select(*[f.name for f in rest], column).mapInArrow(run, schema)
