"""Main text of HTML pages by tag-path ratios.

A page becomes a sequence of blocks (paragraphs, headings, list items, table rows), each with the
path of tags from the root to it. Per path the text outside links, the punctuation and the number
of blocks are added up; the ratios of both to the blocks are smoothed over neighbouring blocks,
fused into one score per path, and paths that reach a threshold are content. The content's nodes
name the part of the page that is the article, and all blocks of that part belong to it, short
ones and headings too. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments, by element, role or class name, are left out before that.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import whole_text

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var td th button select canvas audio video map object noscript template svg "
    "math progress meter datalist applet".split()
)
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template svg math iframe object select button dialog menu canvas "
    "audio video map textarea title fieldset noembed noframes xmp datalist progress meter applet".split()
)
LEFT_OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an element of the key closes when they are still open around it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "option": {"option"}, "body": {"head"},
}
KEEPS_OPEN = frozenset("ul ol dl table html body main article section div blockquote".split())
#: Words at the start or the end of a class or id that name what is left out.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense adslot sponsor sponsored sponsors promo "
    "promos promotion promoted banner nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead footer foot sidebar "
    "sidebars aside rail widget widgets cookie cookies consent gdpr privacy notice notices notification notifications alert "
    "popup modal overlay lightbox newsletter subscribe subscription signup signin login register search searchbox share sharing "
    "shares social related recommended recommendations recommends readmore pager pagination toolbar skip skiplink hidden "
    "disclaimer copyright colophon outbrain taboola teaser teasers toolbox topbar metabar paywall".split()
)
COMMENT_MARKS = frozenset("comment comments commentary commentlist commenters disqus respond replies reply discussion".split())
HEADER_MARKS = frozenset("header head".split())
NOT_A_MARK = frozenset("has with no without is not js".split())
#: Blocks to each side over which ratios are smoothed, and the share of their mean that a path must reach.
RADIUS, THRESHOLD = 2, 0.35
#: A block of text with more than this share in links is a list of links.
LINKS = 0.6
#: A part of the page is the article's if it holds this share of the content.
SHARE = 0.9

_OF_TEXT = frozenset("p li pre blockquote tr table ul ol dl".split()) | HEADINGS
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¿¡]")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / 1.0) ** 2)
#: The rest of a start tag behind its name; a quote counts only after ``=`` and if it ends somewhere.
_REST = re.compile(r"""((?:[^"'>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")


class _Page:
    """Nodes of a page that stand for its block elements, and its blocks of text in order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.path = [-1], [""], [0]
        self.holds_article = [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, list[str], int, int]] = []  # node, pieces, left out by class, characters in links


def _left_out(tag: str, rest: str) -> int:
    """2 if the element is left out, 1 if so by its class or id alone, 3 for a header (an article's keeps its headings)."""
    if tag in LEFT_OUT:
        return 2
    soft = 0
    if tag == "header":
        soft = 3
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _INVISIBLE.search(value)):
                return 2
            if name == "role" and value.strip().lower() in LEFT_OUT_ROLES:
                return 2
            if name in ("class", "id") and tag not in ("html", "body"):
                for one in value.split():
                    words = _WORDS.findall(_CAMEL.sub("-", one).lower())
                    if not words or words[0] in NOT_A_MARK:
                        continue
                    if {words[0], words[-1]} & COMMENT_MARKS:
                        return 2
                    if tag in ("article", "main"):
                        continue
                    if {words[0], words[-1]} & HEADER_MARKS:
                        soft = soft or 3
                    if {words[0], words[-1]} & MARKS:
                        soft = 1
    return soft


def _read(page: str) -> _Page:
    """Nodes and blocks; every character is looked at a bounded number of times."""
    out = _Page()
    # open elements: tag, node of the nearest block element, left out, inside a link
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    opened: dict[str, int] = {}
    current: list[str] = []
    state = [0, 0, 0]  # node, left out and characters in links of the current block

    def flush() -> None:
        if current:
            out.blocks.append((state[0], current.copy(), state[1], state[2]))
            current.clear()
        state[2] = 0

    def pop() -> None:
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tag not in INLINE:
            flush()

    def say(text: str) -> None:
        if not text:
            return
        _, node, left_out, link = stack[-1]
        if not current or state[0] != node or state[1] != left_out:
            if text.isspace() and not current:
                return
            # what is left out inside a block does not cut it in two
            if current and state[0] != node:
                flush()
            elif current and state[1] != left_out:
                if left_out == 2:
                    return
                flush()
            state[0], state[1] = node, left_out
        if left_out == 2:
            return
        if link:
            state[2] += len(text)
        current.append(text)

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            say(entities.unescape(page[at:mark]))
        if mark == size:
            break
        nxt = page[mark + 1 : mark + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                say("<")
                at = mark + 1
            continue
        tag = name[0].lower()
        if closing:
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            if tag == "br":
                say(" ")
            elif opened.get(tag, 0) > 0:
                if tag in INLINE and tag not in ("td", "th"):
                    # an inline end tag does not reach over a block
                    i = len(stack) - 1
                    while stack[i][0] != tag and stack[i][0] in INLINE:
                        i -= 1
                    if stack[i][0] != tag:
                        continue
                while True:
                    last = stack[-1][0]
                    pop()
                    if last == tag:
                        break
            continue
        rest = _REST.match(page, name.end())
        if not rest:
            break  # the page ends inside a tag
        at = rest.end()
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if not end:
                break
            stop = page.find(">", end.end())
            at = size if stop < 0 else stop + 1
            continue
        if tag not in INLINE and (opened.get("p") or tag in HEADINGS):
            # a block ends a paragraph, and whatever is open inside it
            i = len(stack) - 1
            while stack[i][0] in INLINE:
                i -= 1
            if stack[i][0] == "p" or stack[i][0] in HEADINGS and tag in HEADINGS:
                while len(stack) > i:
                    pop()
        ends = [x for x in CLOSES.get(tag, ()) if opened.get(x)]
        if ends:
            i = len(stack) - 1
            while i and stack[i][0] not in KEEPS_OPEN and any(opened[x] for x in ends):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    i = len(stack)
                i -= 1
        if tag == "a" and opened.get("a", 0) and stack[-1][0] == "a":
            pop()
        own = _left_out(tag, rest[1])
        _, node, left_out, link = stack[-1]
        if own == 2 or left_out == 2:
            left_out = 2
        elif tag in HEADINGS and left_out == 3 and (opened.get("article") or opened.get("main")):
            left_out = 0
        elif own and not left_out:
            left_out = own
        elif own == 1:
            left_out = 1
        if tag in INLINE:
            if tag in ("td", "th"):
                say(" ")
            stack.append((tag, node, left_out, link or tag == "a"))
        else:
            flush()
            out.parent.append(node)
            out.tag.append(tag)
            label = (out.path[node], tag)
            out.path.append(out.paths.setdefault(label, len(out.paths) + 1))
            out.holds_article.append(False)
            new = len(out.parent) - 1
            stack.append((tag, new, left_out, link))
            if tag in ("article", "main") and not left_out:
                up = node
                while up >= 0 and not out.holds_article[up]:
                    out.holds_article[up] = True
                    up = out.parent[up]
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def path_scores(paths: np.ndarray, said: np.ndarray, punctuation: np.ndarray) -> np.ndarray:
    """The fused score of each block's path.

    ``said`` has the characters outside links of each block. Both ratios of a path, characters and
    punctuation to blocks, are smoothed along the page; the score of a path is the mean over its
    blocks of the product of the smoothed ratios.
    """
    which, at = np.unique(paths, return_inverse=True)
    n = np.bincount(at)

    def smooth(values: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(values)), _KERNEL)[RADIUS : RADIUS + len(values)]
        return np.convolve(values, _KERNEL)[RADIUS : RADIUS + len(values)] / weight

    text = smooth((np.bincount(at, said) / n)[at])
    marks = smooth((np.bincount(at, punctuation) / n)[at])
    # neighbours lend a path only as much as it has itself twice over
    own_text = np.minimum(text, 2 * (np.bincount(at, said) / n)[at])
    fused = np.sqrt(own_text * (marks + 0.5))
    return (np.bincount(at, fused) / n)[at]


def main_text(page: str) -> str:
    """The article of one page, its blocks joined by empty lines."""
    read = _read(page)
    for strict in (True, False):
        # class names that would leave nothing over are not believed
        chosen = [b for b in read.blocks if b[2] == 0 or not strict and b[2] in (1, 3)]
        said = [" ".join("".join(b[1]).split()) for b in chosen]
        chosen = [(b, t) for b, t in zip(chosen, said) if t]
        if chosen:
            found = _article(read, [b for b, _ in chosen], [t for _, t in chosen])
            if found:
                return "\n\n".join(found)
    return ""


def _article(read: _Page, blocks: list, said: list[str]) -> list[str]:
    size = np.array([len(t) for t in said], float)
    links = np.minimum(np.array([b[3] for b in blocks], float), size)
    free = size - links
    nodes = np.array([b[0] for b in blocks])
    paths = np.array(read.path)[nodes]
    score = path_scores(paths, free, np.array([len(_PUNCTUATION.findall(t)) for t in said], float))
    linked = links > LINKS * size
    if linked.all():
        return []
    reach = THRESHOLD * np.average(score, weights=free + 1e-9)
    content = (score >= reach) & ~linked
    # a heading or content lies well in the article
    fits = content | np.array([read.tag[n] in HEADINGS for n in nodes])
    below, strange = np.zeros(len(read.parent)), np.zeros(len(read.parent))
    np.add.at(below, nodes[content], free[content])
    np.add.at(strange, nodes[~fits], 1)
    largest: dict[int, int] = {}
    # nodes are numbered in page order, so children come after their parents
    for i in range(len(below) - 1, 0, -1):
        up = read.parent[i]
        below[up] += below[i]
        strange[up] += strange[i]
        if up not in largest or below[i] >= below[largest[up]]:
            largest[up] = i
    top = 0
    while top in largest and not (read.tag[top] == "article" and not read.holds_article[top]):
        child = largest[top]
        share = 0.5 if read.tag[child] == "article" else SHARE
        if read.tag[child] in _OF_TEXT or below[child] < share * max(below[top], 1):
            break
        top = child
    # a part whose further blocks are headings and content only belongs to the article
    while read.tag[top] not in ("", "html", "body", "article", "main"):
        up = read.parent[top]
        if read.tag[up] in ("", "html") or strange[up] > strange[top]:
            break
        top = up
    inside = np.zeros(len(below), bool)
    inside[top] = True
    for i in range(top + 1, len(below)):
        inside[i] = inside[read.parent[i]]
    own = inside[nodes]
    if read.tag[top] not in ("article", "main"):
        # without an element that names the article, lists of links are menus
        own &= ~linked
    return [t for t, keep in zip(said, own) if keep]


def extract_main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """Add the main text of each page.

    Character references are decoded, white space inside a block is one space, blocks stand in
    page order with an empty line between. Null and empty pages, and pages without content, have
    an empty text. A page that ends inside a tag or a comment is read up to there; an element that
    is never closed ends with the page. Rows are kept one by one with their other columns, so
    repeated pages stay and an empty table gives no rows; an existing column ``name`` is refused.
    Whole pages are read, in time that grows with their length; nothing moves between tasks.
    """
    if name in pages.columns:
        raise ValueError(f"Column exists: {name}")

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(name, extracted(whole_text(html)))
