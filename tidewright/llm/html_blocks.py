"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. A block is described by its own
word count and link density, those of the blocks before and after it, how much of the page's
plain text its container holds, and a few weak signs: a menu-like element, a heading, a telling
name, words that adverts and notices use and the page's own subject doesn't. A decision tree keeps or
drops each block. It was grown on a small labelled table, the blocks of PAGES invented pages whose parts
are known (``llm.page_table``), and lies beside this module as ``html_tree.json``.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import small_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Content that is never text.
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "object", "svg", "textarea", "title")
REGION_TAGS = frozenset("nav footer aside form menu button select dialog fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption caption".split())
#: Elements that gather a few short texts of one flow.
INNER_TAGS = frozenset("ul ol dl tr tbody thead tfoot table header figure".split())
#: Parts of class, id, role and label names that often mark what is not the article: a weak sign.
NAMES_APART = frozenset(
    "ad ads advert advertisement sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe signup login share social "
    "comment comments reply replies disqus sidebar related recommended nav navbar navigation menu breadcrumb breadcrumbs pagination header footer masthead widget copyright legal".split()
)
#: Words that adverts, notices, forms and reader comments use more often than articles.
CUES = frozenset(
    "cookie cookies consent subscribe newsletter sponsored advertisement anzeige werbung publicité publicidad share tweet facebook "
    "comment comments kommentar kommentare commentaires comentarios reply replies antworten répondre login register imprint impressum privacy datenschutz "
    "buy discount offer shipping click abonnieren related © newsletters advertise".split()
)
#: A tag as a browser reads it: a quote counts only where a value begins; a tag that the page doesn't
#: end goes on to the page's end.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(>|\Z)"
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW_TAGS}
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Plain words from which a text says what its page is about.
LONG_TEXT = 30
#: Words of a link that may be a paragraph of its own.
LONG_LINK = 8
_HREF = re.compile(r"(?:^|\s)href\b", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+|©")
_MARK = re.compile(r"data-keep=\"(\w)\"")


@dataclass(eq=False, slots=True)
class Element:
    """A block-level element. What holds for all that is inside it is known from its parent on; words
    are added to the innermost element and summed upwards once."""

    tag: str
    named: bool
    mark: str
    parent: Element | None = None
    plain: int = 0  # plain (unlinked) words inside
    titled: bool = False  # holds the page's first h1, main or article
    region: bool = False
    header: bool = False
    heading: str = ""
    holder: Element | None = None  # the nearest element that isn't one of a few short texts
    apart: float = 0.0
    held: int = 0  # plain words inside that aren't in a part apart
    article: int = 0  # those of the largest article or main around

    def __post_init__(self) -> None:
        p = self.parent
        self.mark = self.mark or (p.mark if p else "")
        self.region = self.tag in REGION_TAGS or bool(p and p.region)
        self.header = self.tag == "header" or bool(p and p.header)
        self.heading = self.tag if self.tag in HEADINGS else p.heading if p else ""
        self.holder = self if self.tag not in TEXT_TAGS and self.tag not in INNER_TAGS else p.holder if p else None


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    inside: Element | None
    before_title: bool = False

    @property
    def mark(self) -> str:
        return self.inside.mark if self.inside else ""


def telling(attributes: str) -> bool:
    """Whether a class, id, role or label holds one of NAMES_APART."""
    for m in _NAME.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").replace("_", "-")
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
        if NAMES_APART.intersection(_PART.findall(value)):
            return True
    return False


@dataclass
class Cutter:
    """Cuts one page into its non-empty text blocks, in order."""

    out: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    open_at: dict[str, list[int]] = field(default_factory=dict)  # of each tag, where it stands in the stack
    texts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    link_depth: int = -1  # number of open elements where a link began; -1 outside of links
    seen: set[str] = field(default_factory=set)  # of h1, main and article, those that have begun

    def close(self) -> None:
        text = " ".join(html.unescape("".join(self.texts)).split())
        if text:
            words = len(text.split())
            linked = min(words, len(html.unescape(" ".join(self.links)).split()))
            inside = self.stack[-1] if self.stack else None
            if inside:
                inside.plain += words - linked
            self.out.append(Block(text, words, linked, inside, "h1" not in self.seen))
        self.texts.clear()
        self.links.clear()

    def take(self, piece: str) -> None:
        self.texts.append(piece)
        if self.link_depth >= 0:
            self.links.append(piece)

    def cut_to(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.open_at[e.tag].pop()
        del self.stack[depth:]
        if self.link_depth > depth:
            self.link_depth = -1

    def tag(self, closing: bool, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link_depth = len(self.stack) if not closing and _HREF.search(attributes) else -1
        elif tag == "br":
            self.texts.append(" ")
        elif tag in BLOCK_TAGS:
            self.close()
            if closing:
                if self.open_at.get(tag):
                    self.cut_to(self.open_at[tag][-1])
            elif tag not in VOID_TAGS and not attributes.endswith("/"):
                last = self.stack[-1].tag if self.stack else ""
                if last == "p" or (last == tag and tag in ("li", "dt", "dd", "option")):  # these end where the next begins
                    self.cut_to(len(self.stack) - 1)
                mark = _MARK.search(attributes) if attributes else None
                says = bool(attributes) and tag not in ("html", "body") and telling(attributes)
                self.open_at.setdefault(tag, []).append(len(self.stack))
                self.stack.append(Element(tag, says, mark[1] if mark else "", self.stack[-1] if self.stack else None))
                self.elements.append(self.stack[-1])
                if tag in ("h1", "main", "article") and tag not in self.seen:
                    self.seen.add(tag)
                    for e in self.stack:
                        e.titled = True


def after_raw(page: str, tag: str, at: int) -> int:
    """Where a raw element's content and end tag are over."""
    m = _RAW_END[tag].search(page, at)
    return m.end() if m else len(page)


def after_declaration(page: str, at: int) -> int:
    """Where what begins with ``<!`` or ``<?``, or with ``</`` and no name, is over: a comment at its
    own end, anything else at the next ``>``; the page's end where there is none."""
    if page.startswith("<!--", at):
        if page.startswith(("<!-->", "<!--->"), at):
            return page.index(">", at) + 1
        m = _COMMENT_END.search(page, at + 4)
        return m.end() if m else len(page)
    mark = "]]>" if page.startswith("<![CDATA[", at) else ">"
    end = page.find(mark, at)
    return len(page) if end < 0 else end + len(mark)


def cut(page: str) -> Cutter:
    """One pass over the page."""
    c, at, n = Cutter(), 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            c.take(page[at:])
            break
        if begin > at:
            c.take(page[at:begin])
        m = _TAG.match(page, begin)
        if m:
            at, tag = m.end(), m[2].lower()
            if not m[4]:
                break  # a page may be cut off within a tag
            if tag in RAW_TAGS:
                if not m[1] and not (tag == "svg" and m[3].endswith("/")):
                    at = after_raw(page, tag, at)
                c.take(" ")
            else:
                c.tag(bool(m[1]), tag, m[3])
        elif page.startswith(("<!", "<?", "</"), begin):
            at = after_declaration(page, begin)
            if page.startswith(("<!--", "<![CDATA["), begin):
                c.take(" ")
        else:
            c.take("<")
            at = begin + 1
    c.close()
    if "h1" not in c.seen:  # nothing comes before a title that isn't there
        for b in c.out:
            b.before_title = False
    for e in reversed(c.elements):  # an element is made after the one around it
        if e.parent:
            e.parent.plain += e.plain
    return c


def blocks_of(page: str) -> list[Block]:
    return cut(page).out


FEATURES = (
    "words", "link density", "words before", "link density before", "words after", "link density after", "words two after", "container share", "article rank",
    "best article share", "region", "header", "heading", "named", "cue words", "under a cue", "before title",
)
#: The first so many are the blocks' own and their neighbours' counts.
COUNTS = 7


def set_apart(elements: list[Element], page_words: int) -> None:
    """``apart`` of each element: 1 inside of a part with a telling name, 0.5 where only a text's own
    element has one. What holds the page's title and a fifth of its text is no part apart, whatever
    its name."""
    for e in elements:
        whole = e.titled and (e.tag in ("main", "article", "h1") or 5 * e.plain > page_words) or 10 * e.plain > 9 * page_words and e.tag not in TEXT_TAGS
        own = 0.0 if not e.named or whole else 0.5 if e.tag in TEXT_TAGS else 1.0
        e.apart = max(own, e.parent.apart if e.parent else 0.0)


def cue_shares(blocks: list[Block]) -> list[float]:
    """The share of each block's words that are cues. A word that the page's title or one of its long
    texts uses is what the page is about, and no cue; nor are one or two among many other words."""
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    topic = {w for b, ws in zip(blocks, words, strict=True) if (b.inside and b.inside.heading == "h1") or b.words - b.link_words >= LONG_TEXT for w in ws if w in CUES}
    out = []
    for b, ws in zip(blocks, words, strict=True):
        found = [w for w in ws if w in CUES and w not in topic]
        few = len(set(found)) < 3 and 5 * len(found) < b.words
        out.append(0.0 if few or (b.inside and b.inside.heading == "h1") else len(found) / b.words)
    return out


def featured(page: Cutter) -> np.ndarray:
    """A row of FEATURES for each block. Shares are of the plain words outside of menu-like
    elements and parts with telling names, whose own share is 0. Linear in the page."""
    blocks = page.out
    n = len(blocks)
    own = np.array([[b.words, b.link_words / b.words] for b in blocks], float).reshape(n, 2)
    edge = np.zeros((2, 2))
    before, after, later = np.vstack((edge[:1], own[:-1])), np.vstack((own[1:], edge[:1])), np.vstack((own[2:], edge))[:n]
    set_apart(page.elements, sum(b.words - b.link_words for b in blocks))
    inside = [b.inside for b in blocks]
    region = np.array([bool(e and e.region) for e in inside], bool)
    name = np.array([e.apart if e else 0.0 for e in inside])
    apart = region | (name == 1)
    for e in page.elements:
        e.held = e.article = 0
    rest = 0
    for b, off in zip(blocks, apart, strict=True):
        if not off:
            rest += b.words - b.link_words
            if b.inside:
                b.inside.held += b.words - b.link_words
    for e in reversed(page.elements):
        if e.parent:
            e.parent.held += e.held
    for e in page.elements:
        e.article = max(e.held if e.tag in ("article", "main") else 0, e.parent.article if e.parent else 0)
    rest = max(1, rest)
    share, article, heading, under = (np.zeros(n) for _ in range(4))
    cues = np.array(cue_shares(blocks)) if n else np.zeros(0)
    current = 0.0
    for i, (b, e, off) in enumerate(zip(blocks, inside, apart, strict=True)):
        if not off:
            share[i] = e.holder.held / rest if e and e.holder else 1.0
            article[i] = (e.article if e else 0) / rest
        level = e.heading if e else ""
        heading[i] = 1.0 if level == "h1" else 0.5 if level else 0.0
        if level and (level == "h1" or b.words <= 6):  # a heading below the title names what follows
            current = float(level != "h1" and cues[i] > 0)
        under[i] = current
    best = np.full(n, article.max() if n else 0.0)
    rank = article / np.maximum(best, 1e-12)  # 1 in the page's largest article, less in teasers, 0 outside of any
    header, early = np.array([bool(e and e.header) for e in inside], float), np.array([b.before_title for b in blocks], float)
    return np.column_stack((own, before, after, later[:, 0], share, rank, best, region, header, heading, name, cues, under, early))


# --- the tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    share: float
    feature: int = -1
    split: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Node:
    """A binary tree by Gini impurity; equal gains take the first feature and lowest split. At
    most 64 splits of a feature are tried at a node, at even steps of its distinct values."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or n < 2 * least:
        return Node(share)
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        splits = (values[1:] + values[:-1]) / 2
        if len(splits) > 64:
            splits = splits[np.linspace(0, len(splits) - 1, 64).astype(int)]
        if not len(splits):
            continue
        order = np.argsort(x[:, f], kind="stable")
        kept = np.concatenate(([0.0], np.cumsum(y[order])))
        low = np.searchsorted(x[order, f], splits, "right")
        k, high = kept[low], n - low
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = 2 * k * (1 - k / low) + 2 * (kept[-1] - k) * (1 - (kept[-1] - k) / high)
        cost[(low < least) | (high < least)] = np.inf
        i = int(cost.argmin())
        if np.isfinite(cost[i]) and (best is None or cost[i] < best[0] - 1e-9):
            best = (float(cost[i]), f, float(splits[i]))
    if best is None:
        return Node(share)
    left = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (kept: 1) of the blocks of marked pages."""
    x, y = [], []
    for page in pages:
        c = cut(page)
        x.append(featured(c))
        y += [int(b.mark == "1") for b in c.out]
    return np.vstack(x), np.array(y)


def grown() -> Node:
    from tidewright.llm.page_table import pages

    return grow(*labelled(pages()))


#: The grown tree: ``python -m tidewright.llm.html_blocks`` writes it anew.
TREE = Path(__file__).with_name("html_tree.json")


def plain(node: Node) -> list:
    """A tree as nested lists."""
    return [node.share] if node.feature < 0 else [node.share, node.feature, node.split, plain(node.low), plain(node.high)]


def planted(rows: list) -> Node:
    return Node(*rows) if len(rows) == 1 else Node(*rows[:3], planted(rows[3]), planted(rows[4]))


@lru_cache(maxsize=1)
def tree() -> Node:
    return planted(json.loads(TREE.read_text()))


def path_of(node: Node, row: np.ndarray) -> tuple[float, list[int]]:
    """The share of kept blocks at a row's leaf, and the features asked on the way."""
    asked = []
    while node.feature >= 0:
        asked.append(node.feature)
        node = node.low if row[node.feature] <= node.split else node.high
    return node.share, asked


def kept(page: Cutter, model: Node) -> np.ndarray:
    """Which blocks belong to the article. A paragraph that is one long link stays between two that do."""
    x = featured(page)
    keep = np.array([path_of(model, row)[0] >= 0.5 for row in x], bool)
    around = lambda e: e.parent if e and e.tag in TEXT_TAGS else None
    for i in np.flatnonzero(~keep[1:-1] & keep[:-2] & keep[2:]) + 1:
        b, row = page.out[i], dict(zip(FEATURES, x[i], strict=True))
        beside = {id(around(page.out[k].inside)) for k in (i - 1, i, i + 1)}
        if len(beside) == 1 and around(b.inside) and b.words >= LONG_LINK and b.link_words == b.words and not row["region"] and not row["named"] and not row["cue words"] and not row["under a cue"]:
            keep[i] = True
    return keep


def main_text(page: str | None, model: Node) -> str:
    """The kept blocks, joined by an empty line; empty for a null, empty or textless page."""
    c = cut(page or "")
    if not c.out:
        return ""
    return "\n\n".join(b.text for b, stays in zip(c.out, kept(c, model), strict=True) if stays)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null, empty and textless html give an empty text; null ids and urls stay null; repeated rows
    are extracted each; a very long page is read whole, by one task; an empty table gives an empty
    one. Other columns are not read, whatever their names.
    """
    model = tree()  # a few hundred nodes, which travel with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in small_batches(x)):
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    TREE.write_text(json.dumps(plain(grown())) + "\n")
