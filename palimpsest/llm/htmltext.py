"""Main text of HTML pages by the line-block distribution.

Markup is stripped to lines, one for each block-level element, each with its text, how much of that is links, and the
element whose blocks it is one of. Text lengths, less links, are summed over sliding windows of the lines of one
element. Where a sum surges, the lines of its window are text of the article; from there on everything up to the
element's next such line is, unless the sums dive in between. The rest (menus, footers in plain blocks, scattered
lines) never surges and goes.

Everything else only weighs. A character within ``article`` or ``main`` counts six times, elsewhere on a page that has one a
sixty-fourth; in menus, headers, footers, asides, forms and blocks whose class or id speaks of adverts, notices, sidebars or
comments there is nothing to count, unless a form or such a block is wrapped around the page: if what is left without it is a
tenth of it or less, its name says nothing. So a paragraph of an article surges by itself, and a list of links without any name doesn't.
"""

from __future__ import annotations

import heapq
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import small_arrow_batches

#: Lines in a window.
WINDOW = 3
#: A surge: characters in a window. Pages whose richest window is poorer are measured by that window.
SURGE = 86
#: A dive: fewer characters than this in a window between two surges.
DIVE = 12
#: What a character counts within an article or main, and elsewhere on a page that has one.
WITHIN, BESIDE = 6.0, 1 / 64
#: A line with more than this part of its text in links is none of the article's.
LINKED = 0.6
#: A block is wrapped around the page if the rest is so many times smaller.
WRAPPED = 10
#: Elements nested deeper count as their parent's text, as in browsers.
DEEPEST = 512
#: Fixed values of HTML: elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements that stand within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of a page.
HARD = frozenset("head script style noscript template iframe object svg canvas audio video button select option optgroup datalist textarea".split())
#: Elements that hold no article text.
STRUCTURE = frozenset("nav header footer aside dialog menu".split())
#: Elements that hold no article text unless they are wrapped around the page.
SOFT = frozenset("form fieldset".split())
#: Roles that hold no article text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id that weigh against a block; those in the second row hold articles of others.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer "
    "sidebar sidebars aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social footer header masthead popup modal overlay "
    "newsletter subscribe subscription signup login search toolbar skip copyright".split()
)
FIRM = frozenset("comment comments disqus respond reply replies related recommended recommendations".split())
#: Words that say nothing beside such a word. Within an article a name counts only if all its words are of these lists (ad-box, not related-work).
NEUTRAL = frozenset("box block container wrapper wrap inner outer list item items section area panel slot unit bar row col group top bottom left right main link links button buttons form js id".split())
#: Words that turn such a name into a statement about the page (no-sidebar, comments-open).
STATES = frozenset("no not has have with without hide hidden open closed enabled disabled free none off on".split())
#: Fixed values of HTML: what a start tag closes though its end tag is missing, and the elements beyond which it closes nothing.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SCOPES = frozenset("html template table td th caption object applet marquee".split())
LISTS = SCOPES | frozenset("ul ol menu dir dl blockquote section article aside nav header footer main form fieldset details dialog figure button select".split())
CELLS = frozenset("td th tr".split())
SECTIONS = CELLS | frozenset("thead tbody tfoot caption colgroup".split())
TABLE_PARTS = frozenset("html body table tr td th thead tbody tfoot caption colgroup".split())
OMITTED = (
    (frozenset({"head"}), BLOCKS | {"body"}, frozenset("template noscript".split())),
    (frozenset({"p"}), BLOCKS, SCOPES | {"button"}),
    (frozenset({"li"}), frozenset({"li"}), LISTS),
    (frozenset("dd dt".split()), frozenset("dd dt".split()), LISTS),
    (frozenset({"option"}), frozenset("option optgroup hr".split()), frozenset("select datalist".split())),
    (frozenset({"optgroup"}), frozenset("optgroup hr".split()), frozenset({"select"})),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("table tr template".split())),
    (CELLS, frozenset({"tr"}), frozenset("table template".split())),
    (SECTIONS, frozenset("thead tbody tfoot".split()), frozenset("table template".split())),
)
CLOSES = {name: [(closed, bounds) for closed, by, bounds in OMITTED if name in by] for _, by, _ in OMITTED for name in by}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are lines of their parent.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd pre blockquote figcaption address summary hr center".split())
#: Comments, sections without markup, declarations, and tags; what the page's end cuts off is one too.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: How an element is marked: not, never text, no article text, no article text unless wrapped around it, and the same if it may hold articles of others.
PLAIN, NEVER, NO_ARTICLE, UNLESS_WRAPPED, OTHERS = range(5)


def _named(values: str) -> tuple[int, bool]:
    """What the names of a class or id say, and whether one of them says nothing else."""
    found, plainly = PLAIN, False
    for name in values.split():
        parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
        if parts & STATES:
            continue
        told = OTHERS if parts & FIRM else UNLESS_WRAPPED if parts & MARKS else PLAIN
        found = max(found, told)
        plainly |= told != PLAIN and parts <= FIRM | MARKS | NEUTRAL
    return found, plainly


def mark(name: str, attributes: str) -> tuple[int, bool]:
    """How an element is marked, and whether that rests on nothing but names that say other things too."""
    if name in HARD:
        return NEVER, False
    if name in ("html", "body"):
        return PLAIN, False
    found = OTHERS if name == "aside" else NO_ARTICLE if name in STRUCTURE else UNLESS_WRAPPED if name in SOFT else PLAIN
    sure = found != PLAIN
    if "=" not in attributes and "hidden" not in attributes:
        return found, False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return NEVER, False
        if key == "role" and value.lower() in ROLES:
            found, sure = max(found, NO_ARTICLE), True
        elif key in ("class", "id") and not (found and name in STRUCTURE):
            told, plainly = _named(value)
            found, sure = max(found, told), sure or plainly
    return found, found != PLAIN and not sure


@dataclass
class Page:
    """Elements and lines of a page. Element 0 is the page; lines are in its order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    mark: list[int] = field(default_factory=lambda: [PLAIN])
    vague: list[bool] = field(default_factory=lambda: [False])
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)

    def element(self, parent: int, name: str, mark: int, vague: bool) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.mark.append(mark)
        self.vague.append(vague)
        return len(self.parent) - 1


class Open:
    """The open elements, outermost first."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.ids: list[int] = []
        self.held: Counter[str] = Counter()
        self.deeper = 0

    def push(self, name: str, id_: int) -> None:
        self.names.append(name)
        self.ids.append(id_)
        self.held[name] += 1

    def cut(self, to: int) -> None:
        self.held.subtract(self.names[to:])
        del self.names[to:], self.ids[to:]

    def closed_by(self, name: str) -> int | None:
        """Place of the outermost element that a start tag closes."""
        found = None
        for closed, bounds in CLOSES.get(name, ()):
            if any(self.held[x] for x in closed):
                for i in range(len(self.names) - 1, -1, -1):
                    if self.names[i] in closed:
                        found = i if found is None else min(found, i)
                    if self.names[i] in bounds:
                        break
        return found

    def ended_by(self, name: str) -> int | None:
        """Place of the element that an end tag closes, with all within it; one within a line closes no block."""
        if self.held[name]:
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] == name:
                    return i
                if name in INLINE and self.names[i] not in INLINE or self.names[i] in SCOPES and name not in TABLE_PARTS:
                    break
        return None


def read(page: str) -> Page:
    """The elements and lines of a page, in one pass over it."""
    out, opened = Page(), Open()
    parts: list[str] = []
    linked, link, breaks, at = 0, -1, 0, 0  # link: depth at which a link was opened

    def close() -> None:
        nonlocal linked, breaks
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.text.append(text)
            out.linked.append(min(linked, len(text)))
            out.at.append(opened.ids[-1] if opened.ids else 0)
        parts.clear()
        linked = breaks = 0

    while at < len(page):
        found = TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if piece.strip():
                breaks = 0
                linked += len(SPACE.sub(" ", html.unescape(piece)).strip()) if link >= 0 else 0
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name or found[0][-1] != ">":
            continue
        ends, attributes = bool(found[1]), found[3]
        if name in RAW and not ends:
            if name in ("xmp", "noembed", "noframes"):
                close()
            end = RAW_END[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            continue
        marked, vague = (PLAIN, False) if ends or name in VOID else mark(name, attributes)
        flows = name in INLINE and not marked
        if name == "br":
            breaks += 1
            parts.append("\n")
            if breaks > 1:
                close()
            continue
        place = opened.ended_by(name) if ends else opened.closed_by(name)
        if ends and opened.deeper and place is None:
            opened.deeper -= 1
            continue
        within = flows if place is None else all(n in INLINE and not out.mark[i] for n, i in zip(opened.names[place:], opened.ids[place:])) and name in INLINE
        if not within:
            close()
        if place is not None:
            opened.cut(place)
        if link >= len(opened.names) or name == "a":
            link = -1
        if ends or name in VOID:
            continue
        if len(opened.names) >= DEEPEST:
            opened.deeper += 1
            continue
        if name == "a":
            link = len(opened.names)
        opened.push(name, out.element(opened.ids[-1] if opened.ids else 0, name, marked, vague))
    close()
    return out


def _holding(page: Page, at: list[int], mass: list[int], around: set[int]) -> list[bool]:
    """Which elements' marks hold, when those that are wrapped around the page are taken off.

    ``at`` and ``mass`` are the lines' elements and characters without links; ``around`` are the elements around articles.
    """
    n = len(page.parent)
    holds = [m != PLAIN for m in page.mark]
    for i in around:
        holds[i] = False
    owner = [0] * n  # the innermost element with a mark that holds, itself included
    for i in range(1, n):
        owner[i] = i if holds[i] else owner[page.parent[i]]
    direct, whole = [0] * n, [0] * n
    for i, m in zip(at, mass):
        direct[owner[i]] += m
    inner: dict[int, list[int]] = {}
    for i in range(n - 1, 0, -1):
        if holds[i]:
            whole[i] += direct[i]
            up = owner[page.parent[i]]
            if up:
                whole[up] += whole[i]
            inner.setdefault(up, []).append(i)
    heap = [(-whole[i], i) for i in inner.get(0, ()) if page.mark[i] in (UNLESS_WRAPPED, OTHERS)]
    heapq.heapify(heap)
    rest = direct[0]
    while heap:
        heaviest, i = heapq.heappop(heap)
        if not heaviest or -heaviest < WRAPPED * rest:
            break
        if page.mark[i] == OTHERS and rest:
            continue
        holds[i] = False
        rest += direct[i]
        for k in inner.get(i, ()):
            if page.mark[k] in (UNLESS_WRAPPED, OTHERS):
                heapq.heappush(heap, (-whole[k], k))
    return holds


def surges(lengths: list[float], least: float, window: int = WINDOW) -> list[bool]:
    """Which lines lie in a window whose sum is at least ``least``."""
    sums = list(itertools.accumulate(lengths, initial=0))
    last = max(0, len(lengths) - window)
    inside, until = [], 0
    for i in range(len(lengths)):
        if i <= last and sums[min(len(lengths), i + window)] - sums[i] >= least:
            until = i + window
        inside.append(i < until)
    return inside


#: A line that states rights, when it isn't within an article.
RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s)|(?:©|\(c\)|copyright)\W{0,4}(?:19|20)\d\d\b|\ball rights reserved\b", re.I)


def _blocks(page: Page, lines: list[int], weight: list[float]) -> list[int]:
    """Those of the lines that the distribution keeps; a line's length is that of its text without links, times its ``weight``."""
    group: dict[int, list[int]] = {}
    bare: dict[int, float] = {}
    for k, w in zip(lines, weight):
        text, at = page.text[k], page.at[k]
        while page.name[at] in PARAGRAPHS or page.name[at] in INLINE:
            at = page.parent[at]
        group.setdefault(at, []).append(k)
        nothing = page.linked[k] > LINKED * len(text) or w <= 1 and RIGHTS.search(text)
        bare[k] = 0 if nothing else w * (len(text) - page.linked[k])
    richest = max((sum(bare[k] for k in own[i : i + WINDOW]) for own in group.values() for i in range(len(own))), default=0)
    if not richest:
        return []
    place = {k: i for i, k in enumerate(lines)}
    sums = list(itertools.accumulate((bare[k] for k in lines), initial=0))
    dives = list(itertools.accumulate((sums[min(len(lines), i + WINDOW)] - sums[i] < DIVE for i in range(len(lines))), initial=0))
    change = [0] * (len(lines) + 1)
    kept: set[int] = set()
    for own in group.values():
        lengths = [bare[k] for k in own]
        core = [x for x, rich in enumerate(surges(lengths, min(SURGE, richest / 2))) if rich and lengths[x]]
        kept.update(own[x] for x in core)
        for x, y in itertools.pairwise(core):
            i, j = place[own[x]], place[own[y]]
            if j - i <= WINDOW or dives[j - WINDOW + 1] == dives[i + 1]:  # no window between the two is a dive
                kept.update(own[x:y])
                change[i] += 1
                change[j] -= 1
    for k, depth in zip(lines, itertools.accumulate(change)):
        if depth and bare[k]:
            kept.add(k)
    for k, after in reversed(list(itertools.pairwise(lines))):  # headings right before what is kept
        if after in kept and bare[k] and page.name[page.at[k]] in HEADINGS:
            kept.add(k)
    return [k for k in lines if k in kept]


def main_text(page: str | None, distribution: bool = True) -> str:
    """The article's blocks joined by a line feed; empty for an empty page or one without text.

    Every line that can be text takes part in the distribution. Containers and marks only weigh: characters within article or main
    count more, elsewhere on such a page less, in blocks that are marked not at all. Without ``distribution`` all lines stay, to compare.
    """
    p = read(page or "")
    n = len(p.parent)
    # Never text; in what may hold articles of others; the outermost article that an element is in.
    never, others, article = [False] * n, [False] * n, [0] * n
    for i in range(1, n):
        up = p.parent[i]
        never[i] = never[up] or p.mark[i] == NEVER
        article[i] = article[up] or (i if p.name[i] in ("article", "main") and not p.mark[i] and not others[up] else 0)
        others[i] = others[up] or p.mark[i] in (NEVER, OTHERS) and not (p.vague[i] and article[up])
    lines = [k for k in range(len(p.text)) if not never[p.at[k]]]
    if not distribution:
        return "\n".join(p.text[k] for k in lines)
    inside = [k for k in lines if article[p.at[k]]]
    around: set[int] = set()
    for i in {article[p.at[k]] for k in inside}:
        # A mark on the way from the page to an article is that of an element that was never closed, or of a wrapper.
        while i and i not in around:
            around.add(i)
            i = p.parent[i]
    holding = inside or lines
    free = around | {i for i in range(1, n) if p.vague[i] and article[i]}
    holds = _holding(p, [p.at[k] for k in holding], [len(p.text[k]) - p.linked[k] for k in holding], free)
    out = [False] * n
    for i in range(1, n):
        out[i] = out[p.parent[i]] or holds[i]
    lines = [k for k in lines if not out[p.at[k]]]
    weight = [1.0 if not inside else WITHIN if article[p.at[k]] else BESIDE for k in lines]
    return "\n".join(p.text[k] for k in _blocks(p, lines, weight))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Null or empty html gives an empty text; rows stay as they are, repeated ones too; columns other than page_id, url and
    html are not read.
    """
    small_arrow_batches(spark)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
