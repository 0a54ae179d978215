"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between block-level tags, with the root-to-leaf path of block elements that
holds it. Text length, link text and punctuation are added up per path. A path's ratio is its plain text per block,
raised by its punctuation per block (prose has both, menus have neither). Ratios are smoothed over the path tree:
paths that meet low in the tree share evidence, so a heading stands with the paragraphs beside it. The smoothed ratio
is fused with fixed cues of element names, and paths under a share of the page's best one are left out. Headings, lists
and short paragraphs in the element that holds a chosen path stay with it, unless they are mostly links.
Class, id and role words that call an element boilerplate ban it only if the page's text is elsewhere.

Pages are independent, so this is one pass without a shuffle; a row's work is linear in its length.

Defined results: null or empty html gives an empty text, and so does a page without content; nulls in other columns
and repeated rows pass through; unclosed tags, stray end tags and unquoted attributes are read as browsers do;
extra columns are ignored by ``extract`` unless named.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names and class or id words
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg math object select button head".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article entry post story".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus foot footer form header legal login masthead menu modal nav navbar navigation newsletter "
    "notice pager pagination popup promo related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
TOPIC_WORDS = frozenset(  # boilerplate words that also name a section of an article
    "banner consent copyright disclaimer foot form legal login notice widget".split()
)
FLOW_TAGS = frozenset(  # parts of running text: what a content element holds beside its paragraphs
    "address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # open elements that a start tag ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table td th div section article main body html".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
LABEL = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…¿¡、。，！？]")


@dataclass
class Block:
    path: tuple[str, ...]
    banned: bool
    within: bool  # inside an element named as the article
    marks: tuple[int, ...]  # elements around it that are called boilerplate, outermost first
    text: str
    linked: int


@dataclass
class _Open:
    tag: str
    name: str
    banned: bool
    within: bool
    marks: tuple[int, ...] = ()


@dataclass
class _Reader:
    """Builds blocks from tags and text in page order."""

    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    topics: list[bool] = field(default_factory=list)  # per mark: by topic words only, inside the article

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            top = self.stack[-1] if self.stack else _Open("", "", False, False)
            self.blocks.append(Block(tuple(o.name for o in self.stack), top.banned, top.within, top.marks, " ".join(words), self.linked))
        self.parts, self.linked = [], 0

    def pop(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` comes first."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 1
        elif tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK_TAGS:
            return
        self.flush()
        self.links = 0
        self.pop({"p"}, SCOPES)
        if tag in CLOSED_BY:
            self.pop(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])
        if tag in VOID_TAGS:
            return
        above = self.stack[-1] if self.stack else _Open("", "", False, False)
        labels = [w for m in LABEL.finditer(attributes) for w in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower())]
        banned = above.banned or tag in BOILERPLATE_TAGS or (tag == "header" and not above.within)
        plain = tag not in ("html", "body")
        within = above.within or tag in CONTENT_TAGS or (plain and not CONTENT_WORDS.isdisjoint(labels))
        words = BOILERPLATE_WORDS.intersection(labels) if plain and tag not in CONTENT_TAGS else set()
        if within:  # an article has a header of its own
            words = words - {"header"}
        marks = above.marks
        if words or tag == "form":
            marks = (*marks, len(self.topics))
            self.topics.append(above.within and words <= TOPIC_WORDS)
        self.stack.append(_Open(tag, ".".join([tag, *labels[:3]]), banned, within, marks))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        elif tag in BLOCK_TAGS:
            self.flush()
            self.pop({tag}, frozenset())


def read_blocks(page: str) -> list[Block]:
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            reader.end(tag)
        elif tag in RAW_TAGS:
            reader.parts.append(" ")
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = n
        else:
            reader.start(tag, m[3] or m[6] or "")
    reader.flush()
    held = _kept_marks(reader)
    for b in reader.blocks:
        b.banned = b.banned or not held.issuperset(b.marks)
    return reader.blocks


def _ratios(blocks: Sequence[Block]) -> dict[tuple[str, ...], float]:
    """Plain text per block of every path, raised by its punctuation."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    return {p: t / n * math.log(math.e + u / n) for p, (t, u, n) in sums.items()}


def _kept_marks(reader: _Reader) -> set[int]:
    """Elements called boilerplate that hold the page's text all the same.

    Such an element is kept if half of the page's plain text is in it and nothing outside comes near its ratio; one
    that only a topic word marks inside the article, if its ratio is near the article's and its text no small share.
    """
    if not reader.topics:
        return set()
    blocks = [b for b in reader.blocks if not b.banned]
    ratio = _ratios(blocks)
    best, plain, size = ([0.0] * len(reader.topics) for _ in range(3))
    chain: dict[int, tuple[int, ...]] = {}
    alone: dict[tuple[int, ...], tuple[float, bool]] = {}  # blocks by all their marks: best ratio, article among them
    total = 0.0
    for b in blocks:
        text = max(0, len(b.text) - b.linked)
        total += text
        top, named = alone.get(b.marks, (0.0, False))
        alone[b.marks] = max(top, ratio[b.path]), named or b.within
        for i, m in enumerate(b.marks):
            chain[m] = b.marks[: i + 1]
            best[m] = max(best[m], ratio[b.path])
            plain[m] += text
            size[m] += len(b.text)
    kept: set[int] = set()
    outside, named = alone.get((), (0.0, False))
    for m in sorted(chain):
        if not kept.issuperset(chain[m][:-1]) or 2 * plain[m] < size[m]:
            continue
        if reader.topics[m]:
            keep = 2 * best[m] >= outside and 10 * plain[m] >= total
        else:
            keep = not named and 2 * outside < best[m] and 2 * plain[m] >= total
        if keep:
            kept.add(m)
            top, article = alone.get(chain[m], (0.0, False))
            outside, named = max(outside, top), named or article
    return kept


def _tag(name: str) -> str:
    return name.partition(".")[0]


def _top(path: tuple[str, ...]) -> int:
    """Elements of ``path`` down to the body; both html and body may be left out."""
    return sum(_tag(x) in ("html", "body") for x in path[:2])


def _holder(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that holds the running text ``path`` is a part of."""
    while path and _tag(path[-1]) in FLOW_TAGS:
        path = path[:-1]
    return path


def path_scores(blocks: Sequence[Block]) -> dict[tuple[str, ...], float]:
    """Smoothed ratio of every path that no cue bans."""
    ratio = _ratios([b for b in blocks if not b.banned])
    # evidence of the paths below each inner element, by how far below they are
    near: dict[tuple[str, ...], list[float]] = {}
    for p, r in ratio.items():
        for depth in (1, 2):
            if len(p) - depth > _top(p):  # below the body
                e = near.setdefault(p[:-depth], [0.0, 0.0])
                e[0] += r * 4.0**-depth
                e[1] += 4.0**-depth
    smooth = {}
    for p, r in ratio.items():
        shared, weight = r, 1.0
        for depth in (1, 2):
            if len(p) - depth > _top(p):
                e = near[p[:-depth]]
                own = 4.0**-depth
                shared += (e[0] - r * own) * 4.0 ** (1 - depth)
                weight += (e[1] - own) * 4.0 ** (1 - depth)
        smooth[p] = max(r, shared / weight)
    return smooth


def main_text(page: str | None, threshold: float = 0.2) -> str:
    """Blocks of the selected paths, in page order, one per line."""
    if not page:
        return ""
    blocks = read_blocks(page)
    scores = path_scores(blocks)
    best = max(scores.values(), default=0.0)
    if best <= 0:
        return ""
    articles = {b.path for b in blocks if b.within and not b.banned}

    holders = {_holder(p) for p, x in scores.items() if x >= threshold * best}

    def chosen(b: Block) -> bool:
        if b.banned:
            return False
        # blocks of an article, or beside a chosen path in its holder, need no high ratio, only text that is not mostly links
        beside = b.path in articles or _holder(b.path) in holders
        return scores[b.path] >= threshold * best or (beside and 2 * b.linked <= len(b.text))

    found = [b for b in blocks if chosen(b)]
    inside = [b for b in found if b.within]
    # a page that names its article has its text there, unless more prose stands elsewhere: then those are teasers
    prose = sum(len(b.text) for b in found if not b.within and PUNCTUATION.search(b.text))
    if inside and sum(len(b.text) for b in inside) >= prose:
        found = inside
    return "\n".join(b.text for b in found)


def extract(
    pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), threshold: float = 0.2
) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, threshold) for x in b.column(0).to_pylist()]
            n = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), n], [*b.schema.names[1:], "text", "n_chars"])

    fields = [pages.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(html_col, *keep).mapInArrow(run, schema)
