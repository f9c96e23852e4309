"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams its events into blocks (lines): the text between two block-level tags. Each block has a ratio
of characters to tags; links, and blocks in parts whose tag or role says menu, footer and the like, count as tags without text. So do
parts with such a word as a class or id, or the plainer ones as a piece of it (``sidebar-right``), unless they are an article or hold most of the
seed text: then the name speaks of the layout. Comments go even if they hold most, as long as other seeds stay. States (``has-sidebar``) and other pieces only lower the ratio. The smoothed ratios are split into two clusters; the blocks of the upper one are the seeds of the content. The text has
every article that holds a seed, and the smallest part of the page that holds all seeds outside articles (its main part, if it lies in
one; without either, as much around it as adds no block made mostly of links). Every block in them outside such parts belongs to the text,
short ones included.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
# parts that are never main text
DROPPED = frozenset("head title script style noscript template nav header footer aside form menu dialog button select option textarea label fieldset iframe object embed svg canvas math audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
DROPPED_NAMES = frozenset("""nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead header topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement
advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay newsletter subscribe
subscription signup login social share sharing sharebar related recommended recommendations teaser teasers comment comments commentlist reply replies respond disqus discussion form search searchbox pagination
pager toolbar hidden skip paywall""".split())
# names that drop a part also as a piece of a class or id (sidebar-right, ad-slot); the others may speak of anything there
DROPPED_PIECES = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget ad ads advert adverts advertisement advertising adsense sponsor sponsored
sponsors promo banner cookie cookies gdpr newsletter comments commentlist comment disqus related recommended recommendations teasers sharebar pagination""".split())
COMMENT_PIECES = frozenset("comments commentlist comment disqus replies".split())
STATES = frozenset("has no with without is not category tag open closed enabled disabled on off".split())  # as the first or last piece: a state of the part, or its topic
KEPT_WHOLE = frozenset(["html", "body", "main"])  # their classes speak about the page
LOWERED = 0.25  # the ratio in parts with a dropped name as a piece of a class or id
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figure figcaption details summary".split())  # too small for a region
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIGMA = 1.0


def dropped(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    if tag == "header" and in_article:
        return False  # holds the title of the article
    if tag in DROPPED or "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    return (attributes.get("role") or "").lower() in DROPPED_ROLES or bool(re.search(r"display\s*:\s*none", attributes.get("style") or "", re.I))


def named(tag: str, attributes: dict[str, str | None], in_article: bool) -> tuple[bool, bool, bool]:
    """Whether a class or id drops a part of little seed text, whether it only lowers the ratio, and whether it speaks of comments."""
    if tag in KEPT_WHOLE or not (attributes.get("class") or attributes.get("id")):
        return False, False, False
    names = DROPPED_NAMES - {"header"} if in_article else DROPPED_NAMES
    tokens = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attributes.get('class') or ''} {attributes.get('id') or ''}").lower().split()
    pieces = [[x for x in re.split(r"[^a-z0-9]+", t) if x] for t in tokens]
    telling = [x for x in pieces if x and x[0] not in STATES and x[-1] not in STATES]
    whole = any("".join(x) in names or not DROPPED_PIECES.isdisjoint(x) for x in telling)
    whole = whole and (tag != "article" or in_article)  # an article in another may be a comment
    comments = whole and any(not COMMENT_PIECES.isdisjoint(x) for x in telling)
    return whole, any(not names.isdisjoint(x) for x in pieces), comments


class Blocks(HTMLParser):
    """The blocks of a page in order: text, tags, characters in links, the innermost open part, and whether it is dropped. Parts are numbered
    as they open, from 1 (0 is the page), and know their parent. A tag costs the same however many are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int, bool, int]] = []  # tag, own number or 0, dropped (itself or by a part around it), innermost part
        self.at: dict[str, list[int]] = {}  # tag: where it is open
        self.lines: list[int] = []  # where tags that are not inline are open
        self.walls: list[int] = []  # of these, all but paragraphs
        self.parent, self.tags_of = [0], [""]
        self.named: set[int] = set()
        self.comments: set[int] = set()
        self.lowered: set[int] = set()
        self.ends: list[int] = []
        self.text: list[str] = []
        self.tags, self.link_chars = 0, 0

    def _outside(self) -> tuple[bool, int]:
        return (self.open[-1][2], self.open[-1][3]) if self.open else (False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            drop, part = self._outside()
            self.blocks.append((text, self.tags, self.link_chars, part, drop))
            self.tags = 0
        self.text, self.link_chars = [], 0

    def _push(self, tag: str, drop: bool, is_part: bool) -> int:
        part = self._outside()[1]
        if is_part:
            self.parent.append(part)
            self.tags_of.append(tag)
            part = len(self.parent) - 1
        place = len(self.open)
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.lines.append(place)
            if tag != "p":
                self.walls.append(place)
        self.open.append((tag, part if is_part else 0, drop, part))
        return part

    def _close(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            self.at[tag].pop()
        del self.open[at:]
        for places in (self.lines, self.walls):
            while places and places[-1] >= at:
                places.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        attributes, in_article = dict(attrs), bool(self.at.get("article"))
        if tag in INLINE:
            outside = self._outside()[0]
            drop = outside or dropped(tag, attributes, in_article)
            name = not drop and named(tag, attributes, in_article)[0]
            if drop != outside or name:
                self.flush()
            part = self._push(tag, drop, name)
            if name:
                self.named.add(part)
            return
        self.flush()
        closes = CLOSES.get(tag, ())  # these close one another
        at = max((self.at[x][-1] for x in closes if self.at.get(x)), default=-1)
        if at >= 0 and (not self.walls or self.walls[-1] <= at):
            self._close(at)
            in_article = bool(self.at.get("article"))
        part = self._push(tag, self._outside()[0] or dropped(tag, attributes, in_article), True)
        whole, piece, comments = named(tag, attributes, in_article)
        for told, parts in ((whole, self.named), (piece, self.lowered), (comments, self.comments)):
            if told:
                parts.add(part)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.at.get(tag):
            return
        at = self.at[tag][-1]
        if tag in INLINE and self.lines and self.lines[-1] > at:
            return  # an inline end tag closes nothing outside its block
        outside = at > 0 and self.open[at - 1][2]
        if tag not in INLINE or any(n or drop != outside for _, n, drop, _ in self.open[at:]):
            self.flush()
        self._close(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        self.text.append(data)
        if self.at.get("a"):
            self.link_chars += len(data.strip())

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i) and self.rawdata.find("-->", i + 2) < 0:
            return len(self.rawdata)  # a comment without an end lasts to that of the page
        return super().parse_html_declaration(i)

    # over the tree of parts, each in one pass

    def summed(self, own: list) -> list:
        """For each part the sum over itself and all parts in it."""
        out = list(own)
        for part in range(len(out) - 1, 0, -1):
            out[self.parent[part]] += out[part]
        return out

    def counted(self, parts: Iterable[int]) -> list[int]:
        out = [0] * len(self.parent)
        for part in parts:
            out[part] += 1
        return out

    def nearest(self, chosen: Callable[[int], bool]) -> list[int]:
        """For each part the innermost chosen part around it, itself included; 0 if none."""
        out = [0] * len(self.parent)
        for part in range(1, len(out)):
            out[part] = part if chosen(part) else out[self.parent[part]]
        return out

    def farthest(self, chosen: Callable[[int], bool]) -> list[int]:
        """For each part the outermost chosen part around it, itself included; 0 if none."""
        out = [0] * len(self.parent)
        for part in range(1, len(out)):
            out[part] = out[self.parent[part]] or (part if chosen(part) else 0)
        return out

    def last(self, part: int) -> int:
        """The last part in a part: those in it are numbered one after another."""
        if not self.ends:
            self.ends = list(range(len(self.parent)))
            for x in range(len(self.ends) - 1, 0, -1):
                self.ends[self.parent[x]] = max(self.ends[self.parent[x]], self.ends[x])
        return self.ends[part]

    def meeting(self, a: int, b: int) -> int:
        """The smallest part that holds two parts."""
        while a != b:
            a, b = (self.parent[a], b) if a > b else (a, self.parent[b])
        return a


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = max(1, math.ceil(2 * sigma))
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, radius, mode="edge"), weights / weights.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between two clusters of the values (means, until stable). One value alone, or equal ones, lie above it."""
    low, high = float(values.min()), float(values.max())
    while high > low:
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        if not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def seeds(ratios: np.ndarray) -> np.ndarray:
    level = smoothed(np.log1p(ratios))
    seed = (level >= threshold(level)) & (ratios > 0)
    return seed if seed.any() else ratios > 0


def named_parts(page: Blocks, seed: np.ndarray) -> list[bool]:
    """Which parts go for a name of their own or of a part around them. A name counts if its part holds at most half of the seed text, if the page
    has seeds in an article beside it, or if it speaks of comments and seeds stay without it."""
    size = len(page.parent)
    mass, in_article = [0] * size, [0] * size
    article = page.nearest(lambda part: page.tags_of[part] == "article")
    for (text, _, _, part, _), s in zip(page.blocks, seed):
        if s:
            mass[part] += len(text)
            in_article[article[part]] += 1
    in_article[0] = 0  # seeds by their innermost article
    mass, below = page.summed(mass), page.summed(in_article)
    above = [0] * size  # seeds of the articles around a part
    for part in range(1, size):
        above[part] = above[page.parent[part]] + in_article[page.parent[part]]
    gone = {part for part in page.named if 2 * mass[part] <= mass[0] or below[0] - above[part] - below[part] > 0}
    under = page.farthest(gone.__contains__)
    kept = page.summed(page.counted(b[3] for b, s in zip(page.blocks, seed) if s and not under[b[3]]))
    for part in sorted(page.comments - gone):
        if not under[part] and kept[part] < kept[0]:
            gone.add(part)
            break  # parts with most of the seed text lie in one another: the outermost goes, and all in it
    return [bool(x) for x in page.farthest(gone.__contains__)]


def main_text(html: str) -> str:
    page = Blocks()
    page.feed(html)
    page.close()
    page.flush()
    blocks, tags_of = page.blocks, page.tags_of
    ratios = np.array([0.0 if drop else max(0, len(text) - links) / max(1, tags) for text, tags, links, _, drop in blocks])
    if not ratios.any():  # all text is in links: they count as text where the page itself says what is main
        body = page.farthest(lambda part: tags_of[part] in ("article", "main"))
        ratios = np.array([0.0 if drop or not body[part] else len(text) / max(1, tags) for text, tags, _, part, drop in blocks])
        if not ratios.any():
            return ""
    lowered = page.nearest(page.lowered.__contains__)
    ratios *= [LOWERED if lowered[b[3]] else 1.0 for b in blocks]
    if page.named:
        gone = named_parts(page, seeds(ratios))
        left = np.array([not gone[b[3]] for b in blocks])
        if (ratios * left).any():  # else the names leave nothing
            ratios *= left
            blocks = [b if x else (*b[:4], True) for b, x in zip(blocks, left)]
    article = page.farthest(lambda part: tags_of[part] == "article")
    sown = [b[3] for b, s in zip(blocks, seeds(ratios)) if s]
    articles = {article[part] for part in sown} - {0}
    beside = [part for part in sown if not article[part]]
    around = -1  # the smallest part that holds all seed blocks outside articles; 0 is the whole page
    if beside:
        around = page.meeting(min(beside), max(beside))
        while around and tags_of[around] in PARAGRAPHS | INLINE:
            around = page.parent[around]
        main = page.farthest(lambda part: tags_of[part] == "main")[around]
        if main:
            around = main
        elif not articles:
            around = widened(around, blocks, page, lowered)
    last = page.last(around) if around >= 0 else -1
    return "\n".join(text for text, _, _, part, drop in blocks if not drop and (article[part] in articles or around >= 0 and around <= part <= last))


def widened(around: int, blocks: list, page: Blocks, lowered: list[int]) -> int:
    """The largest part around a region that adds no block made mostly of links or in a part of lowered ratio: titles, leads and last sections in parts of their own."""
    links, via = [0] * len(page.parent), [0] * len(page.parent)
    for text, _, in_links, part, drop in blocks:
        if not drop and 2 * in_links > len(text):
            links[part] += 1
        elif not drop and lowered[part]:
            via[lowered[part]] += 1  # speaks against all parts around the lowered one
    for part, n in enumerate(via):
        if part:
            links[page.parent[part]] += n
    against = page.summed(links)
    while around and against[page.parent[around]] == against[around] + via[around]:
        around = page.parent[around]
    return around


SCHEMA = "page_id bigint, url string, text string"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for each row. A missing or empty page has the empty text, as has one without content; broken markup is read as
    far as the parser goes, to its end. Repeated rows are read each for itself; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(t) if t else "" for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, SCHEMA)
