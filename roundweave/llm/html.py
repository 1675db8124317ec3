"""Main text of web pages (operator 6).

The standard library's parser is fed a page and sends events. They build blocks
of text (the "lines" of the page), each with the number of tags in it and the
containers it lies in. A block's text-to-tag ratio is its characters per tag.
The ratios are smoothed by a Gaussian along the page, and split into two
clusters by a threshold (two means in one dimension). The blocks of the upper
cluster say where the content is: it is the innermost container that holds
nearly all of their text, an article or main element before others. All blocks of that container are returned, short ones
too, but for those in elements that hold no content by what they are or are
called (menus, adverts, forms, comments and so on); such blocks take no part in
the clustering either. Within an article or main element a name isn't enough: it must be a
whole class or role, and the element must be mostly links or have a low ratio. If names leave
nothing of a page, they don't count, nor does the only form of a page that holds all its text. In a page without containers the text reaches from the
first block of the upper cluster to the last. Unless it is an article or main element, the region
goes on over the blocks before and after it, whatever container they lie in and however short
they are, until a run of blocks that are mostly links.

Which part decides: on a page with an article or main element that holds the upper cluster, that element,
and the ratios only confirm it; names take out what lies around and in it. On a page without
such elements and without telling names the ratios alone decide.

One pass without a shuffle, and one page in memory at a time. Time and memory are in
proportion to the page, however deep its elements lie in each other and however much of its markup is never ended: the parser gets the
page up to its last ``>``, after which nothing can end, and does not look twice for the end of a comment or section that isn't there.

Edge cases: a null page counts as empty and has an empty text; broken or unclosed
markup is read as far as it goes, and what comes after the last ``>`` as text; a marked section of no known kind
is a comment up to the next ``>``; repeated rows give equal rows; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roundweave.llm.common import small_batches, utf8

#: Elements by what they are; names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article body center div main section table td".split())
NO_TEXT = frozenset("applet audio button canvas datalist footer form head iframe menu nav noscript object script select style svg template textarea title video aside dialog".split())
#: Elements that end when another of them begins in the same parent.
ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in a class, id or role by which an element holds no content.
WORDS = r"(?:ads?|adverts?|advertisements?|advertising|adsense|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|disclaimer|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|outbrain|overlay|pager|pagination|popup|promo|promoted|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|tags|toolbar|topbar|widget)"
NOT_CONTENT = re.compile(rf"(?:^|[_-]){WORDS}s?(?:$|[_-])", re.IGNORECASE)
ONLY_WORD = re.compile(rf"{WORDS}s?", re.IGNORECASE)
#: Words that only say what a page has, as in has-sidebar or comments-open.
SAYS_ONLY = re.compile(r"^(?:has|have|is|no|not|with|without|show|hide)[_-]|[_-](?:open|closed|enabled|disabled|on|off)$", re.IGNORECASE)
#: Marked sections that the parser knows.
SECTION = re.compile(r"<!\[(temp|cdata|ignore|include|rcdata|if|else|endif)(?![\w.-])", re.IGNORECASE)
SIGMA = 1.0
#: What the innermost container must hold of the upper cluster's text.
SHARE = 0.9


class Block:
    """A run of text between two block tags, with the innermost container and suspect it lies in."""

    __slots__ = ("parts", "tags", "links", "container", "suspect")

    def __init__(self, container: int, suspect: int):
        self.parts: list[str] = []
        self.tags, self.links, self.container, self.suspect = 1, 0, container, suspect


class Tree:
    """Nested elements by number. They are numbered as they open, so parents come before children."""

    def __init__(self):
        self.parents: list[int] = []
        self.now = -1  # the innermost open one

    def open(self) -> int:
        self.parents.append(self.now)
        self.now = len(self.parents) - 1
        return self.now

    def close(self) -> None:
        self.now = self.parents[self.now]

    def sums(self, own: np.ndarray) -> np.ndarray:
        """Of numbers per element, those with all that lies in it; one pass from the last element to the first."""
        total = own.tolist()
        for i in range(len(total) - 1, -1, -1):
            if self.parents[i] >= 0:
                total[self.parents[i]] += total[i]
        return np.array(total)

    def ends(self) -> list[int]:
        """The last element within each: what lies in i are the numbers from i to there."""
        last = list(range(len(self.parents)))
        for i in range(len(last) - 1, -1, -1):
            if self.parents[i] >= 0:
                last[self.parents[i]] = max(last[self.parents[i]], last[i])
        return last


def names_no_content(value: str) -> bool:
    """Whether a class, id or role says that an element holds no content."""
    return any(NOT_CONTENT.search(w) and not SAYS_ONLY.search(w) for w in value.split())


def is_named(tag: str, attrs: list, within: bool) -> bool:
    """Whether an element says by a name that it holds no content.

    An id is often made from a heading's words, so one of a heading never counts and one
    of a section only as a whole. Within an article or main only whole classes and roles
    count, but for "header", which belongs to the article there.
    """
    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return False
    for k, v in attrs:
        if not v or k not in ("class", "id", "role"):
            continue
        if within:
            if k != "id" and any(ONLY_WORD.fullmatch(w) and w.lower() != "header" for w in v.split()):
                return True
        elif ONLY_WORD.fullmatch(v.strip()) if tag == "section" and k == "id" else names_no_content(v):
            return True
    return False


class PageEvents(HTMLParser):
    """Turns the parser's events into blocks.

    An event costs the same however deep it lies: where elements of a tag are open
    is kept by tag, and what they lie in is a number.
    """

    def __init__(self, by_name: bool = True, in_form: bool = False):
        super().__init__(convert_charrefs=True)
        self.by_name, self.in_form = by_name, in_form  # in_form: what an outer form holds counts as well
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, without content, container, suspect
        self.places: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.block_depths: list[int] = []
        self.container_depths: list[int] = []
        self.forms = 0  # those not within others
        self.containers, self.suspects = Tree(), Tree()  # suspects are elements within an article that are named as no content
        self.hidden = 0
        self.articles: set[int] = set()  # the containers that are articles by name
        self.bodies: set[int] = set()
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.endless: dict[str, int] = {}  # from where on no comment and no section has an end

    def read(self, page: str) -> None:
        """All events of a page."""
        end = page.rfind(">") + 1
        self.feed(page[:end])
        self.close()
        if end < len(page):
            self.handle_data(unescape(page[end:]) if not self.cdata_elem else page[end:])

    def _ended(self, kind: str, i: int, find: Callable[[int, int], int], report: int) -> int:
        """Where a comment or section ends; -1 if nowhere, for which the page is searched once."""
        if i >= self.endless.get(kind, i + 1):
            return -1
        end = find(i, report)
        if end < 0:
            self.endless[kind] = i
        return end

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._ended("-->", i, super().parse_comment, report)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        name = SECTION.match(self.rawdata, i)
        if not name:
            return self.parse_bogus_comment(i, report)
        return self._ended("]>" if name[1].lower() in ("if", "else", "endif") else "]]>", i, super().parse_marked_section, report)

    def _place(self, *tags: str) -> int:
        """Depth of the innermost open element of one of some tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, hides, is_container, is_suspect = self.stack.pop()
            self.places[tag].pop()
            self.hidden -= hides
            if is_container:
                self.containers.close()
                self.container_depths.pop()
            if is_suspect:
                self.suspects.close()
            if tag in BLOCKS:
                self.block_depths.pop()
                self.now = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.now = None
            # a paragraph ends where the next block begins
            if self.block_depths and self.stack[self.block_depths[-1]][0] in HEADINGS | {"p"}:
                self._close(self.block_depths[-1])
            if tag in ENDS_BEFORE:
                ends = self._place(*ENDS_BEFORE[tag])
                if ends > self._place("ul", "ol", "dl", "table", "div"):
                    self._close(ends)
        elif self.now is not None:
            self.now.tags += 1
        if tag == "br" and self.now is not None:
            self.now.parts.append(" ")
        if tag in VOID:
            return
        within = bool(self.places.get("article") or self.places.get("main"))
        named = self.by_name and is_named(tag, attrs, within)
        outer = tag == "form" and not self.places.get("form")
        self.forms += outer
        hides = (tag in NO_TEXT and not (outer and self.in_form)) or (tag == "header" and not within) or (named and not within) or any(k == "hidden" for k, _ in attrs)
        is_suspect = named and within  # whether it goes is decided by its text
        if is_suspect:
            self.suspects.open()
        if tag in CONTAINERS:
            number = self.containers.open()
            self.container_depths.append(len(self.stack))
            if tag in ("article", "main"):
                self.articles.add(number)
            elif tag == "body":
                self.bodies.add(number)
        self.hidden += hides
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_depths.append(len(self.stack))
        self.stack.append((tag, hides, tag in CONTAINERS, is_suspect))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        open_ = self.places.get(tag)
        at = open_[-1] if open_ else -1
        # an end tag may end nothing within its container
        if at >= 0 and (tag in BLOCKS or not self.container_depths or at > self.container_depths[-1]):
            self._close(at)
        if self.now is not None:
            self.now.tags += 1

    def handle_data(self, data: str) -> None:
        if self.hidden or (self.now is None and not data.strip()):
            return
        if self.now is None:
            self.now = Block(self.containers.now, self.suspects.now)
            self.blocks.append(self.now)
        self.now.parts.append(data)
        if self.places.get("a"):
            self.now.links += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios smoothed by a Gaussian; the ends are repeated outwards."""
    width = int(3 * sigma + 0.5)
    kernel = np.exp(-np.arange(-width, width + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, width, mode="edge"), kernel / kernel.sum(), mode="valid")


def two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers: the middle of their means.

    The least number, if the upper mean is not even twice the lower: one cluster.
    """
    threshold = (values.min() + values.max()) / 2
    for _ in range(50):
        upper, lower = values[values >= threshold], values[values < threshold]
        if not len(lower) or upper.mean() < 2 * lower.mean():
            return float(values.min())
        moved = (upper.mean() + lower.mean()) / 2
        if moved == threshold:
            break
        threshold = moved
    return float(threshold)


Blocks = list[tuple[str, Block]]


def without_suspects(blocks: Blocks, suspects: Tree) -> Blocks:
    """Without the elements named as no content that are mostly links or have a low ratio; all, if none were left."""
    if not suspects.parents:
        return blocks
    own = np.zeros((3, len(suspects.parents)), np.int64)
    for words, block in blocks:
        if block.suspect >= 0:
            own[:, block.suspect] += len(words), min(len(words), block.links), block.tags
    chars, links, tags = map(suspects.sums, own)
    least = two_means(np.array([max(0, len(w) - b.links) / b.tags for w, b in blocks])) if blocks else 0.0
    goes = ((2 * links >= chars) | (chars - links < least * tags)).tolist()
    for i, parent in enumerate(suspects.parents):  # what lies in one that goes, goes
        goes[i] = goes[i] or (parent >= 0 and goes[parent])
    return [(w, b) for w, b in blocks if b.suspect < 0 or not goes[b.suspect]] or blocks


def read(page: str, by_name: bool = True, in_form: bool = False) -> tuple[Blocks, PageEvents]:
    """The blocks of a page that may be content, with their words."""
    events = PageEvents(by_name, in_form)
    events.read(page)
    return without_suspects([(w, b) for b in events.blocks if (w := " ".join("".join(b.parts).split()))], events.suspects), events


def reached(blocks: Blocks, at: int, step: int) -> int:
    """How far the text goes on from a block: to where two blocks or the last one are mostly links."""

    def goes_on(i: int) -> bool:
        return 0 <= i < len(blocks) and 2 * blocks[i][1].links < len(blocks[i][0])

    while goes_on(at + step) or goes_on(at + 2 * step):
        at += step if goes_on(at + step) else 2 * step
    return at


def main_text(page: str) -> str:
    """The main text of a page: its blocks in order, joined by a space."""
    blocks, events = read(page)
    if not blocks:  # a page all of which seems to be no content is read without regard to names, or in its only form
        ways = [(True, True), (False, False)] if events.forms == 1 else [(False, False)]
        blocks, events = max((read(page, *way) for way in ways), key=lambda x: sum(len(w) for w, _ in x[0]))
        if not blocks and events.forms == 1:
            blocks, events = read(page, False, True)
    if not blocks:
        return ""
    # a link's text counts for nothing, so lists of links have low ratios
    ratios = np.array([max(0, len(w) - b.links) / b.tags for w, b in blocks])
    smooth = smoothed(ratios)
    upper = smooth >= two_means(smooth)
    own = np.zeros(len(events.containers.parents), np.int64)
    total = 0
    for (words, block), is_upper in zip(blocks, upper):
        if is_upper:
            total += len(words)
            if block.container >= 0:
                own[block.container] += len(words)
    chosen = np.flatnonzero(events.containers.sums(own) >= SHARE * total).tolist()
    if chosen:
        # containers are numbered as they open, and these lie in each other
        articles = events.articles.intersection(chosen)
        inner = max(articles or chosen)
        end = events.containers.ends()[inner]
        if articles:
            return " ".join(w for w, b in blocks if inner <= b.container <= end)
        at = np.array([i for i, (_, b) in enumerate(blocks) if inner <= b.container <= end]) if inner not in events.bodies else np.flatnonzero(upper)
    else:
        at = np.flatnonzero(upper)
    first, last = reached(blocks, at[0], -1), reached(blocks, at[-1], 1)
    return " ".join(w for w, _ in blocks[first : last + 1])


def extract(pages: DataFrame, html: str = "html", keys: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """The key columns, ``text`` and ``n_chars`` of every page."""
    small_batches(pages.sparkSession)
    keys = list(keys)
    schema = pages.select(*keys).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py().decode("utf-8", "replace")) for v in batch.column(batch.num_columns - 1)]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return pages.select(*keys, utf8(html).alias("__html")).mapInArrow(run, schema)
