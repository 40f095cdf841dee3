"""Main text of web pages by two-pass block rules.

A page is read once, tag by tag, into blocks: stretches of text between block-level tags, each with its length, the share
of it that stands inside links, the share of its words that are stop words, and where it stands (menus, forms, adverts and
the like by element or by the words of class, id and role; an article or main element, or one named as content; a heading).

First pass, each block by itself: what stands in a menu, footer, form, notice, advert, sidebar or among comments is
boilerplate, and so are link lists and, on a page that marks its article, whatever stands outside it. Long blocks with
enough stop words are text, and so are all long ones of a marked article. Short blocks, and ones in whose words no known language shows, are
left open. Second pass: an open block takes the label of the nearest decided block of the innermost container that has one, the page at last; at equal distance text wins inside an article and for blocks without links. A heading looks at what follows it. A page on which nothing is decided as text
keeps its open blocks.

Null and empty pages give an empty text. Character references are decoded once, white space inside a block becomes one space, blocks
are joined by one space in page order; tags may be unclosed, wrongly nested or cut off at the end. Repeated rows are read
each for itself; an empty table gives an empty result. Extra columns of any name aren't read. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters from which on a block is long, and up to which it is short.
LONG, SHORT = 200, 70
#: Share of stop words from which on a block reads as text, and a long one.
STOP_HIGH, STOP_LOW = 0.3, 0.15
#: Share of a block inside links from which on it is a link list, and in an article.
LINKS, ARTICLE_LINKS = 0.3, 0.6

# Common function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his if in into is it its more no not of on one or other our she so some
    such than that the their them then there these they this to was we were what when which who will with would you
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous
    als am auch auf aus bei bin bis da das dass dem den der des die dies durch ein eine einem einen einer es für hat ich im ist kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
    al algo como con cuando del desde el ella ellos entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se sin sobre su sus también tiene todo un una y ya
    """.split()
)

# What elements are to a page.
#: Elements whose content isn't markup and no text of the page.
RAW = frozenset("title style script noscript iframe textarea".split())
#: Elements that aren't main text by themselves.
ASIDE = frozenset("nav aside footer form fieldset menu dialog address head template object svg math canvas audio video select option datalist button".split())
#: What marks the article: the strongest mark on a page counts.
ARTICLE = {"article": 3, "main": 2}
#: Names of class, id, role or itemprop that mark it on pages without such elements.
CONTENT = frozenset("article articlebody article-body article-content content main main-content maincontent post post-body post-content entry entry-content story story-body".split())
#: Elements that end the text before them and start anew.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr
    html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
_STRONG = ASIDE | set(ARTICLE) | set("body html div section header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id, role and label that name what isn't main text.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disclaimer discussion disqus
    feedback footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pagination pager popup privacy promo promotion promoted recommended recommendations related
    replies reply respond search share sharing sidebar signin signup site-header skip social sponsor sponsored subscribe subscription tabs teaser toc toolbar topbar tracking widget widgets alert""".split()
)
#: Of these, words that name the whole page where body or the article carries them.
_NAMED = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_UNSEEN = re.compile(r"""(^|\s)hidden(\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_HINT = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Comments and declarations, and tags, whose quoted values may hold the sign that ends them.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)

_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in RAW}
#: Elements that stand in each other deeper than this aren't told apart.
DEEPEST = 512

TEXT, OTHER, OPEN = 1, 0, None


@dataclass
class Block:
    """A stretch of text and what its place says about it."""

    text: str
    links: int
    aside: bool
    article: int
    heading: bool
    #: Number of the innermost container that it stands in, 0 for the page.
    inside: int = 0


def content(attributes: str) -> bool:
    """Whether the element is named as the page's content."""
    return any(name.lower() in CONTENT for _, value in _NAMED.findall(attributes) for name in value.strip("\"'").split())


def hinted(attributes: str) -> bool:
    """Whether class, id, role or label name something that isn't main text, or the element isn't seen."""
    if not attributes:
        return False
    for _, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _HINT.findall(name)]
            if name.lower() in HINTS or any(w in HINTS for w in words):
                return True
            if "header" in words and words != ["header"] and "article" not in words and "post" not in words and "entry" not in words:
                return True
    return bool(_UNSEEN.search(attributes))


class _Reader:
    """Blocks of one page; ``read`` goes through its markup once."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: Open elements as (name, not main text, strongest mark of an article).
        self.open: list[tuple[str, bool, int]] = []
        #: Of each container the one around it, and the containers that are open.
        self.around, self.inside = [0], [0]
        self.parts: list[str] = []
        self.links, self.anchor, self.heading = 0, 0, False

    def _end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            aside, article = self.open[-1][1:] if self.open else (False, 0)
            self.blocks.append(Block(text, self.links, aside, article, self.heading, self.inside[len(self.open)]))
        self.parts, self.links, self.heading = [], 0, False

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.anchor:
                self.links += len(" ".join(text.split()))

    def _start(self, name: str, attributes: str) -> None:
        aside, article = self.open[-1][1:] if self.open else (False, 0)
        if name == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
            self.inside.pop()
            aside, article = self.open[-1][1:] if self.open else (False, 0)
        if name in BLOCKS:
            self._end()
            self.anchor = 0
            self.heading = name in HEADINGS
        elif name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.anchor = 1
        if name in VOID:
            return
        if name == "body":
            self.open.clear()
            del self.inside[1:]
            aside, article = False, 0
        if len(self.open) < DEEPEST and (name in BLOCKS or name in ASIDE or attributes and hinted(attributes)):
            whole = name in ("html", "body")
            own = not whole and (name in ASIDE or (name == "header" and not article) or hinted(attributes))
            if own and name not in BLOCKS:
                self._end()
            mark = 0 if aside or own else max(article, ARTICLE.get(name, 0), int(not whole and content(attributes)))
            self.open.append((name, aside or own, mark))
            if name in _STRONG:
                self.around.append(self.inside[-1])
            self.inside.append(len(self.around) - 1 if name in _STRONG else self.inside[-1])

    def _close(self, name: str) -> None:
        if name == "a":
            self.anchor = 0
        if name in BLOCKS or any(name == x for x, *_ in self.open):
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == name), None)
            if at is None and name != "p":
                return
            self._end()
            # a stray end of an inner element doesn't close an article or what lies outside it
            if at is not None and (name in _STRONG or not any(x in _STRONG for x, *_ in self.open[at + 1 :])):
                del self.open[at:], self.inside[at + 1 :]

    def read(self, page: str) -> list[Block]:
        at, n = 0, len(page)
        while at < n:
            tag = page.find("<", at)
            if tag < 0:
                self._text(page[at:])
                break
            m = _MARKUP.match(page, tag)
            if not m:
                self._text(page[at : tag + 1])
                at = tag + 1
                continue
            self._text(page[at:tag])
            at = m.end()
            close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if close:
                self._close(name)
            elif name in RAW and not attributes.rstrip().endswith("/"):
                found = _RAW_ENDS[name].search(page, at)
                at = found.end() if found else len(page)
            else:
                self._start(name, attributes)
        self._end()
        return self.blocks


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block, marked: bool) -> int | None:
    """The label of a block by itself; None if it is open. ``marked``: the page marks its article."""
    share = b.links / len(b.text)
    if b.aside or marked and not b.article:
        return OTHER
    if share > (ARTICLE_LINKS if b.article else LINKS) and not b.heading:
        return OTHER
    if len(b.text) < SHORT or b.heading:
        return OPEN
    stop = stop_share(b.text)
    if len(b.text) >= LONG:
        return TEXT if stop >= STOP_LOW or b.article else OPEN
    return TEXT if stop >= STOP_HIGH else OPEN


def decided(blocks: list[Block], around: list[int]) -> list[int]:
    """The label of every block, after both passes; around: the container around each container."""
    marked = max((b.article for b in blocks), default=0)
    for b in blocks:
        b.article = int(b.article == marked > 0)
    labels = [first_pass(b, marked > 0) for b in blocks]
    if TEXT not in labels:
        return [TEXT if x is None else x for x in labels]
    # of each container, the decided blocks in it; what is boilerplate by its place says nothing about its neighbours
    inside: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        if labels[k] is not None and not b.aside:
            c = b.inside
            while True:
                inside.setdefault(c, []).append(k)
                if not c:
                    break
                c = around[c]
    out = []
    for k, b in enumerate(blocks):
        c = b.inside
        while labels[k] is None and c and c not in inside:
            c = around[c]
        out.append(_inherit(labels, inside[c], k, b) if labels[k] is None else labels[k])
    return out


def _inherit(labels: list[int | None], at: list[int], k: int, b: Block) -> int:
    """The label of the nearest of the decided blocks ``at``; a heading looks ahead."""
    j = bisect(at, k)
    before, after = at[j - 1] if j else None, at[j] if j < len(at) else None
    if before is None or after is None:
        return labels[after if before is None else before]
    if b.heading:
        return labels[after]
    if k - before == after - k:
        return max(labels[before], labels[after]) if b.article or not b.links else min(labels[before], labels[after])
    return labels[before if k - before < after - k else after]


def main_text(page: str) -> str:
    """The text of a page's article."""
    reader = _Reader()
    blocks = reader.read(page)
    return " ".join(b.text for b, label in zip(blocks, decided(blocks, reader.around), strict=True) if label == TEXT)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.lots(it):
            found = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
