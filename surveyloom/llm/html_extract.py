"""Main text of web pages by paths that a host's pages agree on.

Every page scores its containers, climbs from the best one while a parent adds text, and votes for the
generalised tag-class path it comes to. The votes of a host are counted in Spark; its pages are then read
again from the winning path, or from their own best container where they don't have it, and climb likewise.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import stage
from surveyloom.llm.url_filter import url_parts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_MARK = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside menu dialog button select option svg math canvas audio video map".split()) | RAW
#: What an open head can hold; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Plain characters, mostly not links, that a parent must add to be climbed to.
LEAST_ADDED = 20
#: Elements that an opening tag closes if they are open within the nearest container.
_ENDS_P = BLOCKS - {"html", "body"}
#: Words of a class, id or role that mark what is never the article.
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation navigational menu menus breadcrumb breadcrumbs "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply "
    "replies discussion pagination pager".split()
)
#: Words, and forms, that mark what is apart only where the page's text does not lie within; see ``_lifted``.
ASIDE = frozenset(
    "banner sidebar sidebars aside side rail complementary footer foot colophon contentinfo masthead header topbar toolbar notice notices notification notifications alert popup modal overlay "
    "widget widgets search skip hidden".split()
)
#: A class name that says what there isn't marks nothing: no-sidebar, has-comments.
_SAID = frozenset("no not without has with".split())
#: Plain characters of a marked part of an article that is read as text, if a third at most is links.
LEAST_PART = 200


class Block(NamedTuple):
    """Text between two block borders, with its innermost container and marked region (-1 for none)."""

    text: str
    container: int
    region: int
    linked: int
    title: bool

    @property
    def read(self) -> int:
        """Its plain characters, if it is mostly not links."""
        return len(self.text) - self.linked if 2 * self.linked < len(self.text) else 0


class Region(NamedTuple):
    """A marked element: the region around it, whether its mark is a weak one, and whether it lies in an article."""

    parent: int
    weak: bool
    in_article: bool


class Page(NamedTuple):
    """Blocks that are not set apart; of every container (parents first) path, depth, score, parent, tag, plain characters, title."""

    blocks: list[Block]
    paths: list[str]
    depths: list[int]
    scores: list[float]
    parents: list[int]
    tags: list[str]
    plain: list[int]
    titled: list[bool]


def _mark(attributes: str) -> frozenset | None:
    """APART or ASIDE where a class, id or role has one of its words, APART first."""
    found = None
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            words = _MARK.split(name)
            if _SAID.isdisjoint(words):
                if not APART.isdisjoint(words):
                    return APART
                if not ASIDE.isdisjoint(words):
                    found = ASIDE
    return found


def _label(tag: str, attributes: str) -> str:
    """Tag and sorted classes; numbers are generalised."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() == "class":
            classes = sorted({_DIGITS.sub("0", x) for x in (a or b or c).lower().split()})
            return ".".join([tag, *classes])
    return tag


def _lifted(blocks: list[Block], regions: list[Region], holds: list[bool]) -> list[bool]:
    """Regions that are read like the rest of the page.

    A weak mark is lifted where the region has half of the page's plain text, or a quarter and an article, main
    or h1, or is a part of an article with LEAST_PART plain characters and few links; text under strong
    marks doesn't count. Strong marks stay, unless the page has no other text.
    """
    plain, links = [0] * len(regions), [0] * len(regions)
    apart = []
    for region in regions:
        apart.append(not region.weak or (region.parent >= 0 and apart[region.parent]))
    total = 0
    for block in blocks:
        if block.region < 0 or not apart[block.region]:
            total += block.read
            if block.region >= 0:
                plain[block.region] += block.read
                links[block.region] += block.linked
    for i in range(len(regions) - 1, -1, -1):  # regions within come later
        parent = regions[i].parent
        if parent >= 0 and not apart[i]:
            plain[parent] += plain[i]
            links[parent] += links[i]
    out: list[bool] = []
    for i, region in enumerate(regions):
        most = 2 * plain[i] >= total > 0 or (holds[i] and 4 * plain[i] >= total > 0)
        part = region.in_article and plain[i] >= LEAST_PART and 3 * links[i] <= plain[i]
        out.append((region.parent < 0 or out[region.parent]) and region.weak and (most or part))
    for chosen in (out, [not a for a in apart]):
        if any(b.region < 0 or chosen[b.region] for b in blocks):
            return chosen
    return [True] * len(regions)


def parse(source: str) -> Page:
    """Blocks, containers and scores of a page; markup, dropped elements and what is set apart are left out.

    A container scores the characters of its text, less those in links, and again half of what lies in
    containers of its own. ``plain`` counts the characters of its blocks that are mostly not links, and ``titled``
    says that one of these is an h1; see ``climbed``. Time and memory are linear in the page, however deep
    it nests: a path is a digest of its parent's path and its own label.
    """
    blocks: list[Block] = []
    paths, parents, tags, depths = [], [], [], []
    regions: list[Region] = []
    holds: list[bool] = []
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, container around, region around, dropped, link
    counts: Counter = Counter()
    inside = region = -1
    piece: list[str] = []
    linked, dropped, links = 0, 0, 0
    at, length = 0, len(source)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(piece)).strip() if piece else ""
        piece.clear()
        if text:
            blocks.append(Block(text, inside, region, min(linked, len(text)), counts["h1"] > 0))
        linked = 0

    def close(upto: int) -> None:
        nonlocal inside, region, dropped, links
        while len(stack) > upto:
            tag, container, around, drop, link = stack[-1]
            if tag in BLOCKS or tag == "form":
                flush()  # the block is still in it
            stack.pop()
            counts[tag] -= 1
            inside, region = container, around
            dropped -= drop
            links -= link

    while at < length:
        m = _TOKEN.search(source, at)
        if m is None:
            m_start = length
        else:
            m_start = m.start()
        if m_start > at and stack and stack[-1][0] == "head" and source[at:m_start].strip(" \t\n\r\f\ufeff"):
            close(len(stack) - 1)
        if m_start > at and not dropped:
            text = entities.unescape(source[at:m_start])
            piece.append(text)
            if links:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            found = False
            for i in range(len(stack) - 1, -1, -1) if counts[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    found = True
                    break
                if stack[i][0] in ("article", "main", "body", "td", "table") and tag not in BLOCKS:
                    found = True
                    break
            if not found and tag in BLOCKS and not dropped:
                flush()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        attributes = m[3] if m[2] else m[6]
        if tag in VOID:
            if not dropped:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    piece.append(" ")
            continue
        if tag in RAW:  # no markup until the end tag
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else length
            continue
        if tag in ("html", "body") and counts[tag]:
            continue
        if tag == "body" and counts["head"]:
            close(next(i for i, s in enumerate(stack) if s[0] == "head"))
        if tag in _ENDS_P or tag in DROPPED:
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i][0]
                if open_tag == "p" or (open_tag == tag and tag in ("li", "td", "th", "tr", "option")) or (tag in ("dd", "dt") and open_tag in ("dd", "dt")):
                    close(i)
                    break
                if open_tag in CONTAINERS or open_tag in ("ul", "ol", "dl", "table", "form") or open_tag in DROPPED or not (counts["p"] or counts[tag] or tag in ("dd", "dt")):
                    break
        if (tag in BLOCKS or tag == "form") and not dropped:
            flush()
        mark = _mark(attributes) if attributes and tag not in ("html", "body", "article", "main") else None
        drop = tag in DROPPED or (mark is not None and tag not in BLOCKS and tag != "form")  # within a line
        stack.append((tag, inside, region, drop, tag == "a"))
        counts[tag] += 1
        if not dropped and not drop:
            if mark or tag == "form":
                regions.append(Region(region, mark is not APART, counts["article"] + counts["main"] > 0))
                holds.append(False)
                region = len(regions) - 1
            elif tag in ("article", "main", "h1"):
                up = region
                while up >= 0 and not holds[up]:
                    holds[up] = True
                    up = regions[up].parent
            if tag in CONTAINERS:
                above = paths[inside] if inside >= 0 else ""
                paths.append(xxhash.xxh3_128_hexdigest(f"{above}>{_label(tag, attributes)}".encode("utf-8", "replace")))
                depths.append(depths[inside] + 1 if inside >= 0 else 1)
                parents.append(inside)
                tags.append(tag)
                inside = len(paths) - 1
        dropped += drop
        links += tag == "a"
        if drop and dropped == 1 and tag in BLOCKS:
            flush()
    close(0)
    flush()
    lifted = _lifted(blocks, regions, holds)
    blocks = [b for b in blocks if b.region < 0 or lifted[b.region]]
    count = len(paths)
    sizes, plain, titled = [0] * count, [0] * count, [False] * count
    for b in blocks:
        if b.container >= 0:
            sizes[b.container] += len(b.text) - b.linked + (0 if b.linked else 1)
            plain[b.container] += b.read
            titled[b.container] |= b.title and b.read > 0
    nested = [0] * count
    for i in range(count - 1, -1, -1):  # containers within come later
        up = parents[i]
        if up >= 0:
            sizes[up] += sizes[i]
            nested[up] += sizes[i]
            plain[up] += plain[i]
            titled[up] |= titled[i]
    weight = {"article": 1.5, "main": 1.2}
    scores = [(size - 0.5 * deep) * weight.get(tag, 1.0) for tag, size, deep in zip(tags, sizes, nested)]
    return Page(blocks, paths, depths, scores, parents, tags, plain, titled)


def climbed(page: Page, path: str) -> str:
    """The path, or that of the outermost parents that add plain text or a title to what lies within it.

    An article is left for the title it lacks only, and main not at all.
    """
    at = {i for i, p in enumerate(page.paths) if p == path}
    above, articles = at, 0
    lines: list[set[int]] = []
    while above and not any(page.tags[i] == "main" for i in above):
        above = {page.parents[i] for i in above if page.parents[i] >= 0}
        if above:
            lines.append(above)
            if any(page.tags[i] == "article" for i in above):
                articles = len(lines)
    in_article = articles > 0 or any(page.tags[i] == "article" for i in at)
    for level, above in enumerate(lines):
        title = any(page.titled[i] for i in above) and not any(page.titled[i] for i in at)
        if title or ((not in_article or level < articles) and sum(page.plain[i] for i in above) - sum(page.plain[i] for i in at) >= LEAST_ADDED):
            at = above
    return page.paths[min(at)]


def best_path(page: Page) -> str | None:
    """Path climbed to from the one with the highest total score; of equal ones the deeper, then the smaller."""
    total: dict[str, float] = {}
    for path, score in zip(page.paths, page.scores):
        total[path] = total.get(path, 0.0) + score
    if not total or max(total.values()) <= 0:
        return None
    depth = dict(zip(page.paths, page.depths))
    return climbed(page, min(total, key=lambda p: (-total[p], -depth[p], p)))


def text_at(page: Page, path: str | None) -> str:
    """Blocks within the containers of a path, one a line; all blocks for no path."""
    if path is None:
        return "\n".join(b.text for b in page.blocks)
    within: list[bool] = []
    for own, up in zip(page.paths, page.parents):
        within.append(own == path or (up >= 0 and within[up]))
    return "\n".join(b.text for b in page.blocks if b.container >= 0 and within[b.container])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of a host vote for, ties by the larger score, then by path. Stored."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for host, source in zip(b["host"], b["html"]):
                page = parse(source)
                path = best_path(page)
                if path is not None:
                    found.append((host, path, float(sum(s for p, s in zip(page.paths, page.scores) if p == path))))
            yield pd.DataFrame(found, columns=["host", "path", "score"])

    rows = pages.select(url_parts(F.col("url")).host.alias("host"), "html").where(F.col("html").isNotNull())
    votes = rows.mapInPandas(vote, "host string, path string, score double").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("pages")).alias("pages"), (-F.round("score")).alias("score"), "path")).alias("best"))
    return stage(best.select("host", F.col("best.path").alias("path")), "paths")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page.

    Null pages are empty; pages without text give ''. Null and malformed URLs are one host. A page whose
    text around its host's path is more than what lies within gives it too. Pages
    without their host's path fall back to their own best container, and pages without any
    container to all their blocks: '' is returned only where there is no text. Very long and very deep
    pages are read whole in linear time. Repeated rows stay; other columns are not read.
    """
    winners = host_paths(pages)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for source, path in zip(b["html"], b["path"]):
                page = parse(source or "")
                found = text_at(page, climbed(page, path)) if path in page.paths else ""
                texts.append(found or text_at(page, best_path(page)) or text_at(page, None))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_parts(F.col("url")).host.alias("host"))
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInPandas(read, "page_id long, url string, text string, n_chars long")
