"""Main text of web pages from the text-to-tag ratio of their lines.

The standard library's parser streams events. Each block of text is a line with a ratio of text characters to tags;
the ratios of all lines, in page order, are smoothed with a Gaussian and split by a threshold (two-means, started at
the mean's half and the maximum). The content region is the smallest element that holds nearly all text of the lines
above the threshold, or the article elements if they have most of it or the page's title, or a main element with most;
its lines, short ones too, are the result, with a title that stands right before it.

Menus, headers, footers, sidebars, notices, adverts, forms and comments, named by their tag or role or by a whole class
or id, go. Some pages put such a name on the element that holds all of the page: a named element is a wrapper, and stays,
if it holds most of the dense text that is left and either the title or no prose stands outside it unnamed. One named
as comments, consent or an advert is a wrapper only where nothing else is dense.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.markup import MarkupReader
from tidemark.llm.common import map_rows, schema_of, values

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never page text.
SILENT = frozenset("head title script style noscript template svg math iframe object canvas select textarea button audio video xmp noembed noframes".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
REGIONS = frozenset("article main section div body html td".split())
ARTICLES = frozenset("article main".split())
#: Words of which the names of boilerplate are made, words that may stand beside them, and words that make a class a
#: statement about a page ("has-sidebar", "no-comments", "ad-free") instead of the name of an element.
NAMED = frozenset("ad ads advert adverts advertisement advertising advertisements sponsor sponsored sponsors promo promotion promotions banner adsbygoogle adsense nav navbar navigation menu breadcrumb breadcrumbs side sidebar alert footer masthead cookie cookies consent notice notices gdpr popup modal overlay comment comments disqus reply replies respond share sharing newsletter subscribe subscription signup login related recommended recommendations widget widgets toolbar pagination pager complementary contentinfo search skip social discussion discussions responses talkback outbrain taboola".split())
#: Of these words, those of what readers, advertisers and lawyers say: never the article where there is another text.
OTHERS = frozenset("ad ads advert adverts advertisement advertising advertisements sponsor sponsored sponsors promo promotion promotions adsbygoogle adsense outbrain taboola cookie cookies consent gdpr comment comments disqus reply replies respond responses talkback discussion discussions newsletter subscribe subscription signup".split())
BESIDE = frozenset("site page main global top bottom left right primary secondary first last box bar block section area container wrapper wrap inner outer list item items link links button buttons form panel module group holder slot unit zone content body text title heading header meta info thread tree the our post article entry user reader readers page widget mobile desktop sticky fixed inline small large big wide narrow new policy law message more popular articles posts stories news google also like icon icons row col column grid bg dark light depth even odd children child parent".split())
STATES = frozenset("has have no not non without with free off disabled enabled hide hidden show layout is open closed supports".split())
#: A header is the site's unless it is in an article or named as an article's.
HEADERS = frozenset("header masthead".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: Tags that end an open li and so on, and the elements that hide open ones from them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select", "tbody")
SIGMA = 1.0
SHARE = 0.9
#: A named element is a wrapper only if no more than this share of the dense text around it lies outside it.
OUTSIDE = 0.2
#: Elements of prose, and words that make any line prose.
PROSE, PROSE_WORDS = frozenset("p pre blockquote h1".split()), 12
RIGHTS = re.compile(r"(?i)©|\(c\) |copyright\b")
#: An article beside others of other parents counts if it has this share of the largest one's dense text.
BESIDES = 0.1
#: Lines that may stand between a title and the region that it is the title of.
BETWEEN = 3


def names_boilerplate(token: str) -> bool:
    """Whether a whole class, id or role names boilerplate: made of its words and neutral ones, and no statement."""
    words = [w.lower() for w in WORDS.findall(token)]
    return any(w in NAMED or w in HEADERS for w in words) and not any(w in STATES for w in words) and all(w in NAMED or w in BESIDE or w in HEADERS or w.isdigit() for w in words)


def named_boilerplate(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for token in value.split():
                if names_boilerplate(token):
                    only_header = not any(w.lower() in NAMED for w in WORDS.findall(token))
                    if not (only_header and (inside or re.search("(?i)article|entry|post", token))):
                        return True
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


def of_others(attrs: list[tuple[str, str | None]]) -> bool:
    return any(w.lower() in OTHERS for k, v in attrs if k in ("class", "id", "role") and v for token in v.split() if names_boilerplate(token) for w in WORDS.findall(token))


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    mark: int  # of the innermost named element, -1 in none
    inside: bool  # an article or main element
    block: str  # tag of the innermost block

    def prose(self) -> bool:
        n = self.text.count(" ") + 1
        return (self.block in PROSE and n >= 3 or n >= PROSE_WORDS) and not RIGHTS.match(self.text)


class Mark(NamedTuple):
    around: int  # the mark around it
    may_wrap: bool
    others: bool  # named as comments, consent or an advert


class Blocks(MarkupReader):
    """Collects the lines of a page while events stream by, and the regions they are in.

    Regions are numbered in the order of their start, so one holds those from its own number to its ``last``.
    """

    def __init__(self):
        super().__init__()
        self.stack: list[tuple[str, int, int, bool, bool]] = []  # tag, region, mark, silent, in an article
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of blocks
        self.regions: list[tuple[str, int, str]] = [("", -1, "")]  # tag, parent, class
        self.last: list[int] = [0]
        self.marks: list[Mark] = []
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = 0

    def state(self) -> tuple[int, int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, -1, False, False)

    def cut(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            region, mark, _, inside = self.state()
            self.lines.append(Line(line, max(1, self.tags), region, mark, inside, self.stack[self.blocks[-1]][0] if self.blocks else ""))
            self.tags = 0
        self.text = []

    def push(self, entry: tuple[str, int, int, bool, bool]) -> None:
        if entry[0] in BLOCK:
            self.blocks.append(len(self.stack))
        self.open.setdefault(entry[0], []).append(len(self.stack))
        self.stack.append(entry)

    def pop_to(self, k: int) -> None:
        """Closes the elements from place ``k`` on."""
        while len(self.stack) > k:
            tag, region, *_ = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in REGIONS:
                self.last[region] = len(self.regions) - 1

    def place(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self.pop_to(self.blocks[-1])
            if tag in ENDS and (k := self.place(*ENDS[tag])) > self.place(*LISTS):
                self.pop_to(k)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        region, mark, silent, inside = self.state()
        if tag not in ("html", "body"):
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            by_tag = tag in BOILERPLATE or tag == "header" and not inside
            if by_tag or named_boilerplate(attrs, inside):
                self.marks.append(Mark(mark, not hidden and (tag == "form" or not by_tag), of_others(attrs)))
                mark = len(self.marks) - 1
        if tag in REGIONS:
            self.regions.append((tag, region, next((v or "" for k, v in attrs if k == "class"), "")))
            self.last.append(0)
            region = len(self.regions) - 1
        self.push((tag, region, mark, silent or tag in SILENT, inside or tag in ARTICLES))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        k = self.place(tag)
        # an inline end tag closes nothing outside its block
        if k >= 0 and (tag in BLOCK or not self.blocks or k > self.blocks[-1]):
            self.pop_to(k)

    def handle_data(self, data):
        if not self.state()[2]:
            self.text.append(data)

    def finish(self) -> None:
        self.cut()
        self.pop_to(0)
        self.last[0] = len(self.regions) - 1


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - reach), min(len(ratios), i + reach + 1)
        own = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(k * r for k, r in zip(own, ratios[lo:hi], strict=True)) / sum(own))
    return out


def threshold(ratios: list[float]) -> float:
    """Between the centres of two clusters; at or below every ratio if they are all alike."""
    low, high = sum(ratios) / len(ratios) / 2, max(ratios)
    for _ in range(20):
        middle = (low + high) / 2
        below, above = [r for r in ratios if r < middle], [r for r in ratios if r >= middle]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return min((low + high) / 2, max(ratios))


def boilerplate(p: Blocks, weights: list[float]) -> list[bool]:
    """Of each named element, whether it goes: all but wrappers, and what is in one that goes. ``weights``: of each line,
    its dense text. A form can be a wrapper; other elements named by their tag, and hidden ones, can't."""
    n = len(p.marks)
    inner, own, title, prose, article = [0.0] * (n + 1), [0.0] * (n + 1), [False] * (n + 1), [False] * (n + 1), [False] * (n + 1)  # by mark, the last place for lines in none
    for line, w in zip(p.lines, weights, strict=True):
        inner[line.mark] += w
        own[line.mark] += w
        title[line.mark] |= line.block == "h1"
        prose[line.mark] |= line.prose()
        article[line.mark] |= line.inside
    children: list[list[int]] = [[] for _ in range(n + 1)]
    for m in range(n - 1, -1, -1):
        around = p.marks[m].around
        inner[around] += inner[m]  # -1 is the last place
        title[around] |= title[m]
        children[around].append(m)
    bad = [True] * n
    todo = [n]
    while todo:
        around = todo.pop()
        if article[around]:
            continue  # an article beside them is what the page is about
        can = [m for m in children[around] if p.marks[m].may_wrap and inner[m] > 0]
        left = own[around] + sum(inner[m] for m in can if not p.marks[m].others)
        found = [m for m in can if not p.marks[m].others and left - inner[m] <= OUTSIDE * left and (title[m] or not prose[around])]
        theirs = sum(inner[m] for m in can if p.marks[m].others)
        if not found and not prose[around] and left <= OUTSIDE * theirs:
            found = [m for m in can if p.marks[m].others and theirs - inner[m] <= OUTSIDE * theirs]
        for m in found:
            bad[m] = False
        todo += found
    for m in range(n):  # what is inside boilerplate is boilerplate
        around = p.marks[m].around
        if around >= 0 and bad[around]:
            bad[m] = True
    return bad


def articles(p: Blocks, lines: list[Line], weight: list[float], depth: list[int]) -> list[int]:
    """The outermost article elements if they are what the page is about: together they have most of the dense text
    (``weight`` by region), or the only one has the title. Of several, those of one kind of parent and others that aren't
    short beside the longest; a single one gives way to an article in it that has nearly all of its text."""
    length = by_region(p, lines, [len(x.text) for x in lines])
    outer: list[int] = []
    for r in range(1, len(p.regions)):
        if p.regions[r][0] == "article" and length[r] and not (outer and r <= p.last[outer[-1]]):
            outer.append(r)
    titles = [x.region for x in lines if x.block == "h1"]
    entitled = len(outer) == 1 and any(outer[0] <= r <= p.last[outer[0]] for r in titles)
    if not outer or not entitled and 2 * sum(weight[r] for r in outer) <= weight[0]:
        return []
    longest = max(outer, key=lambda r: length[r])
    parent = lambda r: p.regions[p.regions[r][1]][::2]  # noqa: E731 - tag and class
    kept = [r for r in outer if parent(r) == parent(longest) or length[r] >= BESIDES * length[longest]]
    if len(kept) == 1:
        inside = [r for r in range(kept[0], p.last[kept[0]] + 1) if p.regions[r][0] == "article" and length[r] >= SHARE * length[kept[0]]]
        return [max(inside, key=lambda r: (depth[r], length[r]))]
    return kept


def by_region(p: Blocks, lines: list[Line], weights: list) -> list:
    """Of each region, the weights of its lines and of those in regions inside it."""
    out = [0] * len(p.regions)
    for line, w in zip(lines, weights, strict=True):
        out[line.region] += w
    for r in range(len(p.regions) - 1, 0, -1):
        out[p.regions[r][1]] += out[r]
    return out


def content_regions(p: Blocks, lines: list[Line], weights: list[float]) -> list[int]:
    """Article elements, or a main element with most of the dense text, or the deepest element with nearly all of it. One
    of several elements alike that follow each other (paragraphs as divisions) is no region: what holds them is."""
    weight = by_region(p, lines, weights)
    depth = [0] * len(p.regions)
    for r in range(1, len(p.regions)):
        depth[r] = depth[p.regions[r][1]] + 1
    total = weight[0]
    if found := articles(p, lines, weight, depth):
        return found
    if mains := [r for r in range(len(weight)) if p.regions[r][0] == "main" and 2 * weight[r] > total]:
        return [max(mains, key=lambda r: (depth[r], weight[r]))]
    best = max((r for r in range(len(weight)) if weight[r] >= SHARE * total), key=lambda r: (depth[r], weight[r]))
    textual = {line.region for line in lines}
    alike: dict[tuple, int] = {}
    for r in range(1, len(p.regions)):
        if r in textual:
            alike[p.regions[r]] = alike.get(p.regions[r], 0) + 1
    while best > 0 and p.regions[best][0] in ("div", "section", "td") and alike.get(p.regions[best], 0) > 1:
        best = p.regions[best][1]
    return [best]


def with_title(p: Blocks, lines: list[Line], kept: list[int], region: int) -> list[int]:
    """``kept`` (places of lines) after the title that stands just before, in an element around the region or beside it,
    if there is none among them."""
    if not kept or any(lines[k].block == "h1" for k in kept):
        return kept
    around = set()
    while region > 0:
        region = p.regions[region][1]
        around.add(region)
    for k in range(kept[0] - 1, max(kept[0] - 2 - BETWEEN, -1), -1):
        if lines[k].block == "h1":
            own = lines[k].region
            return [*range(k, kept[0]), *kept] if own in around or p.regions[own][1] in around else kept
    return kept


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by newlines; empty for null, empty or textless pages."""
    if not html:
        return ""
    p = Blocks()
    p.read(html)
    p.finish()
    if not p.lines:
        return ""
    ratios = smoothed([len(x.text) / x.tags for x in p.lines])
    least = threshold(ratios)
    dense = lambda lines, rs: [float(len(x.text)) if r >= least else 0.0 for x, r in zip(lines, rs, strict=True)]
    bad = boilerplate(p, dense(p.lines, ratios))
    lines = [x for x in p.lines if x.mark < 0 or not bad[x.mark]]
    if not lines:
        return ""
    # what was named is gone: the ratios of what stays decide
    ratios = smoothed([len(x.text) / x.tags for x in lines])
    least = threshold(ratios)
    regions = content_regions(p, lines, dense(lines, ratios))  # in order, none in another
    within = lambda r: (k := bisect_right(regions, r)) > 0 and r <= p.last[regions[k - 1]]
    kept = [k for k, x in enumerate(lines) if within(x.region)]
    return "\n".join(lines[k].text for k in with_title(p, lines, kept, regions[0]))


def extracted(pages: DataFrame, *, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``. Map-only.

    A null, empty or textless page has the empty text and 0. Malformed markup never fails: see ``MarkupReader`` for
    what ends a tag, and a tag that never ends is text. Pages of any length and depth take time in proportion to them.
    Repeated rows give equal results; an empty table gives no rows.
    """
    out = schema_of(pages, *keep, more="text string, n_chars bigint")

    def make():
        def fn(batch):
            texts = [main_text(x) for x in values(batch.column("__html"))]
            return {k: batch.column(k) for k in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return fn

    return map_rows(pages.select(*keep, F.col(html_col).cast("string").alias("__html")), make, out)


def op9_text_to_tag(pages: DataFrame) -> DataFrame:
    """Digest per page; see ``extracted``."""
    return extracted(pages, keep=["page_id", "url"])
