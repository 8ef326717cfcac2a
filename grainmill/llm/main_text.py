"""Main text of a web page by tag-path ratios.

The page is read into blocks, each with the path of tags from the root to it. Text length and punctuation are
aggregated per path, fused, smoothed among neighbours of one parent, and blocks over a threshold are the article. Elements,
roles and class names that speak for or against an article only weigh the scores: they decide nothing alone, so a page that
lies in a form, or in an element named after its sidebar, keeps its text.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from grainmill.llm.common import by_row, travels

travels(__name__)

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav footer aside form button select datalist dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in class or id that speak against the article, and words that add nothing to them.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar comment comments disqus reply "
    "replies respond cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription share sharing "
    "social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer masthead login signup search pagination pager widget "
    "hidden skip toolbar topbar".split()
)
NEUTRAL_NAMES = frozenset(
    "area bar block body bottom box buttons column container content form group holder inner item items left link links list main outer panel "
    "posts right row section site slot text thread title top unit wrap wrapper".split()
)
#: What an element weighs: one that is named for something else than the article, one whose name has such a word among others.
NAMED, HINTED = 0.001, 0.6
#: Share of the best score of an article element that all its blocks have.
WITHIN = 0.5
#: A new element of the first kind ends an open element of the second within the same container.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot article section div main body html td th blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<([/]?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


class Block:
    __slots__ = ("article", "heading", "linked", "parts", "path", "text", "weight")

    def __init__(self, path: tuple[str, ...], article: int, weight: float) -> None:
        self.path, self.article, self.weight, self.parts, self.linked, self.text = path, article, weight, [], 0, ""
        self.heading = bool(path) and path[-1] in HEADINGS


def weight_of(tag: str, attributes: str, article: int) -> float:
    """What an element's name, role, class and id say about all in it; 0: it is not shown."""
    if not attributes.strip():
        return NAMED if tag in ASIDE or tag == "header" and not article else 1.0
    if tag not in ("html", "body") and UNSEEN.search(attributes):
        return 0.0
    if tag in ASIDE or tag == "header" and not article or (role := ROLE.search(attributes)) and role[1].lower() in ASIDE_ROLES:
        return NAMED
    weight = 1.0
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(PARTS.findall(name))
            against = words & ASIDE_NAMES or words & {"header"} and not article
            if against and not words - ASIDE_NAMES - NEUTRAL_NAMES - {"header"}:
                return NAMED
            weight = HINTED if against else weight
    return weight


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, without what is not shown. Unclosed elements end with their container."""
    found: list[Block] = []
    stack: list[tuple[str, float, int]] = []  # tag, weight of it and all around it, number of the article or main element around
    current: Block | None = None
    articles = at = 0

    def words(raw: str) -> None:
        nonlocal current
        if not raw or stack and not stack[-1][1]:
            return
        text = html.unescape(raw)
        if current is None:
            if not text.strip():
                return
            path = tuple(tag for tag, _, _ in stack if tag in BLOCK)
            current = Block(path, stack[-1][2] if stack else 0, stack[-1][1] if stack else 1.0)
            found.append(current)
        current.parts.append(text)
        if any(tag == "a" for tag, _, _ in stack):
            current.linked += len(text.strip())

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in BLOCK:
            current = None
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if closing:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_at is not None and (tag in BLOCK or all(s[0] not in BLOCK for s in stack[open_at:])):
                del stack[open_at:]
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        ended = ENDED_BY.get(tag) or ({"p"} | HEADINGS if tag in BLOCK and tag not in HEADINGS else {"p"} if tag in BLOCK else None)
        if ended:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS:
                    break
        around, article = stack[-1][1:] if stack else (1.0, 0)
        weight = around * weight_of(tag, attributes, article)
        if tag in ("article", "main") and not article:
            articles += 1
            article = articles
        stack.append((tag, weight, article))
    for block in found:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in found if b.text]


def scores(found: list[Block], reach: float = 1.0) -> list[float]:
    """Fused score of each block. Per path and weight: text length per block times (1 + punctuation per block), less what is
    link text; then a Gaussian mean over neighbours whose paths have the same parent; in an article element at least a share
    of the best there; times the weight."""
    totals: dict[tuple, list[float]] = {}
    for b in found:
        t = totals.setdefault((b.path, b.weight), [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)))):
            t[i] += x
    ratio = {path: t[1] / t[0] * (1 + t[2] / t[0]) * (1 - t[3] / t[1]) for path, t in totals.items()}
    weights = [math.exp(-(k * k) / (2 * reach * reach)) for k in range(4)]
    smooth, best = [], {}
    for i, b in enumerate(found):
        top = bottom = 0.0
        for k in range(-3, 4):
            if 0 <= i + k < len(found) and found[i + k].path[:-1] == b.path[:-1]:
                top += weights[abs(k)] * ratio[found[i + k].path, found[i + k].weight]
                bottom += weights[abs(k)]
        smooth.append(top / bottom)
        best[b.article] = max(best.get(b.article, 0.0), top / bottom)
    return [b.weight * (max(s, WITHIN * best[b.article]) if b.article else s) for b, s in zip(found, smooth, strict=True)]


def main_blocks(page: str | None, threshold: float = 0.1) -> list[str]:
    """The texts of the article's blocks in page order: those whose score is over `threshold` times the largest, less blocks
    that are mostly links and no headings."""
    found = blocks(page or "")
    if not found:
        return []
    fused = scores(found)
    limit = threshold * max(fused)
    return [b.text for b, s in zip(found, fused, strict=True) if s >= limit and (b.linked < 0.8 * len(b.text) or b.heading)]


def extract(pages: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Main text of whole pages.

    Returns page_id, url, text, n_chars (code points) and n_blocks, one row per input row. Blocks are joined by one line
    break, white space inside a block is one blank, character references are decoded. Null or empty html, and pages
    without text, give an empty text; repeated rows repeat; other columns are ignored.
    """

    def start():
        def one(page: str | None) -> tuple:
            kept = main_blocks(page, threshold)
            text = "\n".join(kept)
            return text, len(text), len(kept)

        return one

    return by_row(pages, ["html"], ["page_id", "url"], "text string, n_chars bigint, n_blocks bigint", start)
