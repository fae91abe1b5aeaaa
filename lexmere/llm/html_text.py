"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks. Parts that are never
the article (menus, page headers, footers, sidebars, notices, adverts, fields,
scripts, styles, reader comments, hidden elements) are left out while parsing.
Two kinds of parts are judged by what they hold: a form goes unless most of the
page's text is in it, and a part whose name may mean a box beside the article
(related, share, tags and the like) goes if it is short or mostly links.
Each block passes points, for itself, its commas and its length, to the elements
around it, less with distance and less for text inside links. The element with
the most points, lowered by its own share of links, is the article; it widens to
a parent that holds clearly more, to all of the article or main element around it,
and elsewhere to parents that add mostly text outside links; siblings with few links
are kept. Lists of links are left out only outside the article.

All sums go once from the leaves to the root, so time grows with the page and not
with its depth.

Defined results: a null or empty page, and one without text, give an empty
string. Unclosed, misnested and cut-off markup is read as far as it goes. Only
the three named columns are read; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import named

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
NEVER = frozenset("script style textarea title noscript iframe noembed noframes template nav footer aside button select option input dialog menu svg annotation annotation-xml object embed canvas audio video map datalist label".split())
BLOCK = frozenset("html body main article section div header hgroup p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption address details summary center hr nav footer aside form fieldset".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body main article".split())
CLOSED_BY_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main nav ol p pre section table ul".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: names of parts that are no article
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit adbanner adcontainer adwrapper sponsor sponsored sponsors "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc footer masthead topbar toolbar "
    "sidebar aside cookie cookies consent gdpr popup modal lightbox "
    "newsletter subscribe signup paywall comment comments disqus respond outbrain taboola skiplink".split()
)
#: names that say so outside an article, and nothing alone within one
OUTSIDE = frozenset("rail register login reply replies overlay notice notices skip".split())
#: names that an article's subject may have: a short part of it stays with them unless it holds links
SUBJECTS = OUTSIDE | frozenset("alert widget widgets subscription discussion response responses promotion promoted".split())
#: names that such a part may have, and a part of the article too
DOUBTFUL = frozenset("alert banner promo promotion promoted widget widgets share sharing social related recommended recommendations tags subscription discussion response responses".split())
FORMS = frozenset("form fieldset".split())
HEADER = frozenset("header head masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GOOD = frozenset("article content main post body entry story text blog page".split())
OWN_HEADER = frozenset("article entry post story".split())
#: names that say what a part has or allows, not what it is
ABOUT = re.compile(r"^(?:has|with|without|no|not|is|show|hide)[-_]|[-_](?:open|closed|enabled|disabled)$", re.I)
LEAST_BLOCK = 25
#: how much of a block's points reaches the elements around it
SHARES = (1.0, 0.5, 0.25, 1 / 6)
#: a doubtful part stays with so many characters and no more than such a share of them in links
LEAST_PART, MOST_LINKED = 120, 0.3
#: what an unnamed footer says, in no more characters
LEGAL, MOST_LEGAL = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I), 200


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _names(attributes: dict[str, str]) -> set[str]:
    whole = [x for k in ("class", "id") for x in attributes.get(k, "").split() if not ABOUT.search(x)]
    return {part.lower() for x in whole for part in NAME_PART.findall(x)}


def _unwanted(tag: str, raw: str, in_article: bool) -> bool:
    """Whether an element and all in it are no part of an article."""
    if tag in NEVER:
        return True
    if tag == "header":
        return not in_article
    if tag in KEPT_WHOLE or not raw or raw.isspace():
        return False
    own = _attributes(raw)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    names = _names(own)
    if tag in HEADING or tag == "a":
        return bool(names & (NOISE | OUTSIDE | DOUBTFUL if tag == "a" else NOISE)) and not names & GOOD
    return bool(names & (NOISE if in_article else NOISE | OUTSIDE)) or (bool(names & HEADER) and not in_article and not names & OWN_HEADER)


class Page:
    """A page's tree, parents before children, and its text blocks in order."""

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.weight = ["#"], [-1], [0.0]
        self.doubtful: list[int] = []
        self.mild: dict[int, bool] = {}
        self.forms: list[int] = []
        #: (block element around it, text, characters of it in links)
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack = [0]
        open_at: dict[str, list[int]] = {}  # where in the stack a tag is open
        block_at = [0]  # where block elements are
        dropped = 0  # depth of the stack at which text is left out, 0 for none
        words: list[str] = []
        linked = 0

        def nearest(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        def flush() -> None:
            nonlocal linked
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((stack[block_at[-1]], text, min(linked, len(text))))
                words.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            nonlocal dropped
            while len(stack) > depth:
                tag = self.tag[stack[-1]]
                if tag in BLOCK:
                    if not dropped:
                        flush()
                    block_at.pop()
                open_at[tag].pop()
                stack.pop()
                if len(stack) < dropped:
                    dropped = 0

        def text(piece: str) -> None:
            nonlocal linked
            if piece and not dropped:
                piece = unescape(piece)
                words.append(piece)
                if open_at.get("a"):
                    linked += len(" ".join(piece.split()))

        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            text(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if html.startswith("<![CDATA[", m.start()):
                    text(html[m.start() + 9 : at].removesuffix("]]>"))
                continue
            tag, closing, raw = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if open_at.get(tag):
                    pop_to(open_at[tag][-1])
                elif tag == "p" and not dropped:
                    flush()
                continue
            if tag == "br" or tag == "hr":
                if tag == "hr" and not dropped:
                    flush()
                text(" ")
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in CLOSED_BY_P and self.tag[stack[block_at[-1]]] == "p":
                pop_to(block_at[-1])
            if tag in SAME_KIND:
                own = nearest(SAME_KIND[tag])
                if own > nearest(SCOPE[tag]):
                    pop_to(own)
            if tag == "a" and open_at.get("a") and open_at["a"][-1] > block_at[-1]:
                pop_to(open_at["a"][-1])
            block = tag in BLOCK
            if block and not dropped:
                flush()
            if raw.endswith("/") and not block:
                continue
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.weight.append(0.0)
            if not dropped:
                in_article = not block or bool(open_at.get("article") or open_at.get("main"))
                if tag in NEVER or self.by_name and _unwanted(tag, raw, in_article):
                    dropped = len(stack) + 1
                elif tag in FORMS:
                    self.forms.append(node)
                elif block:
                    names = _names(_attributes(raw)) if raw and not raw.isspace() else set()
                    if tag in ("article", "main"):
                        self.weight[node] = 25.0
                    elif names & GOOD:
                        self.weight[node] = 15.0
                    if self.by_name and names & (DOUBTFUL | OUTSIDE) and tag not in KEPT_WHOLE and tag not in HEADING:
                        self.doubtful.append(node)
                        self.mild[node] = in_article and not names & (DOUBTFUL - SUBJECTS)
            open_at.setdefault(tag, []).append(len(stack))
            if block:
                block_at.append(len(stack))
            stack.append(node)
        pop_to(1)
        if not dropped:
            flush()

    def _up(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.parent[node]

    def _summed(self, values: list) -> list:
        """Each node's value with those of all below it; 0 for the root."""
        for k in range(len(values) - 1, 0, -1):
            if self.parent[k] > 0:
                values[self.parent[k]] += values[k]
        values[0] = type(values[0])()
        return values

    def _within(self, nodes: Iterable[int]) -> list[bool]:
        """Whether each node is one of these or below one."""
        out = [False] * len(self.tag)
        for k in nodes:
            out[k] = k > 0
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def _measures(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, those in links, blocks, and blocks mostly outside links, in and below each node."""
        n = len(self.tag)
        chars, linked, count, plain = [0] * n, [0] * n, [0] * n, [0] * n
        for own, text, inside in self.blocks:
            chars[own] += len(text)
            linked[own] += inside
            count[own] += 1
            plain[own] += 2 * inside < len(text)
        return tuple(self._summed(x) for x in (chars, linked, count, plain))

    def _drop_parts(self) -> None:
        """Leaves out the blocks of forms and doubtful parts that are no article: of much in links, or short, but for those of an article that only have a subject's name and no links."""
        if not self.blocks or not (self.forms or self.doubtful):
            return
        chars, linked, _, _ = self._measures()
        every = sum(len(t) for _, t, _ in self.blocks)
        gone = {k for k in self.forms if 2 * chars[k] < every}
        gone |= {k for k in self.doubtful if 2 * chars[k] < every and (linked[k] > MOST_LINKED * chars[k] or chars[k] < LEAST_PART and (linked[k] > 0 or not self.mild[k]))}
        if gone:
            inside = self._within(gone)
            self.blocks = [b for b in self.blocks if not inside[b[0]]]

    def main_text(self) -> str:
        """The kept blocks, a line each."""
        self._drop_parts()
        n = len(self.tag)
        chars, linked, count, plain = self._measures()
        points, whole = [0.0] * n, [0.0] * n
        for own, text, inside in self.blocks:
            if len(text) < LEAST_BLOCK or self.tag[own] in HEADING:
                continue
            gain = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - inside / len(text))
            around = self.parent[own] if self.tag[own] in LEAF else own
            if around > 0:
                whole[around] += gain
            for share in SHARES:
                if around <= 0:
                    break
                points[around] += gain * share
                around = self.parent[around]
        whole = self._summed(whole)
        density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
        score = [(points[k] + self.weight[k]) * (1 - density[k]) if points[k] > 0 else 0.0 for k in range(n)]
        for k in self.doubtful:
            score[k] /= 2
        best = max(range(n), key=lambda k: (score[k], -k))
        chosen, kept = -1, None
        if score[best] > 0:
            while True:
                up = self.parent[best]
                if up <= 0 or self.tag[best] in KEPT_WHOLE or whole[up] * (1 - density[up]) < 1.25 * whole[best]:
                    break
                best = up
            around = [k for kind in ("main", "article") for k in self._up(best) if self.tag[k] == kind]
            best = around[-1] if around else best
            chosen = best if self.tag[best] not in ("html", "body") else -1
            while not around and self.tag[best] not in KEPT_WHOLE:
                up = self.parent[best]
                if up <= 0 or self.tag[up] in KEPT_WHOLE or 2 * (plain[up] - plain[best]) < count[up] - count[best]:
                    break
                best = up
            kept = self._within({best} | self._siblings(best, score, chars, density))
        in_chosen = self._within([chosen])
        in_menu = self._within(k for k in range(n) if self.tag[k] in ("ul", "ol", "dl", "table") and density[k] > 0.6)
        return "\n".join(text for own, text, _ in self.blocks if (kept is None or kept[own]) and (in_chosen[own] or not in_menu[own]))

    def _siblings(self, best: int, score: list[float], chars: list[int], density: list[float]) -> set[int]:
        found, doubtful = set(), set(self.doubtful)
        legal = {0}
        for own, text, _ in self.blocks:
            if len(text) <= MOST_LEGAL and LEGAL.search(text):
                for k in self._up(own):
                    if chars[k] > MOST_LEGAL:
                        break
                    legal.add(k)
        for k in range(1, len(self.tag)):
            if self.parent[k] != self.parent[best] or k == best or self.tag[k] not in BLOCK or k in doubtful:
                continue
            if score[k] >= max(10.0, 0.2 * score[best]):
                found.add(k)
            elif self.tag[k] in HEADING and k < best and chars[k]:
                found.add(k)
            elif self.tag[k] in ("p", "pre", "blockquote") and chars[k] > 80 and density[k] < 0.25:
                found.add(k)
            elif self.tag[best] not in ("article", "main") and chars[k] and density[k] < 0.25 and not (k > best and k in legal):
                found.add(k)
        return found


def main_text(html: str) -> str:
    """A page's article; where names leave nothing of a page, only the kinds of its elements count."""
    return Page(html).main_text() or Page(html, by_name=False).main_text()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py()) if h.is_valid else "" for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(named(id_col)).cast("long").alias("page_id"), F.col(named(url_col)).cast("string").alias("url"), F.col(named(html_col)).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
