"""Main text of web pages by two passes over their blocks.

Pass one gives each block a label from its link density, length and share of stop words,
and from the boxes it lies in (menus, footers, adverts, comments are no text; an article
element is).  Pass two settles short and uncertain blocks: they take the label of their
nearest decided neighbours.  One scan of the markup, linear in its length.

Names are evidence only.  A long, dense block outside an article stays text, and an
article with less text than the rest of the page settles nothing.  A class or id names no
box if most of the page's text lies in it.  Where the page as a whole is poor in known
stop words, length and links decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemeter.llm.common import slices, texts

# Common words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une "
    "als am auch auf aus bei das dass dem den der des die ein eine einen einer es für hat ich im in ist mit nach nicht sich sie sind so und von war wie wird zu zum zur "
    "al como con de del el ella en era es esta este esto ha la las lo los más no o para pero por que se si sin su sus un una y ya".split()
)
MARKUP = re.compile(
    r"<!--(?:(?:(?!-->).)*+(?:-->|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("nav footer aside form script style textarea title iframe noscript template button select option svg math object canvas dialog menu noembed noframes xmp head".split())
ARTICLE = frozenset("article main".split())
# Names of boxes, as words of a class or id.
BOX = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tions?)?|banner|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side-?bar|footer|"
    r"comments?|commentlist|respond|disqus|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|pagination|pager|toolbar|masthead|site-header|page-header|widget|skip-link)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
# A start tag that ends an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
LONG, SHORT, LINKS, MANY_STOPS, FEW_STOPS = 200, 70, 0.5, 0.3, 0.15
# Letters of scripts that say in one what others say in about three.
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    article: bool
    boxed: bool
    named: int = -1  # the innermost box that only a class or id names
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""
    size: int = 0  # without blanks
    share: float = 0.0  # of stop words

    def measure(self) -> bool:
        """Set what the labels go by; whether there is any text."""
        self.text = " ".join("".join(self.parts).split())
        if self.text:
            words = self.text.lower().split()
            self.size = sum(map(len, words))
            self.share = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
        return bool(self.text)


def box(name: str, rest: str, inside: bool) -> bool:
    """Whether an element holds no main text, by its name, role or style."""
    if name in NEVER or (name == "header" and not inside):
        return True
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" and not rest[m.start() - 1 : m.start()].strip(" \t\n\"'"):
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def box_name(name: str, rest: str) -> bool:
    """Whether an element's class or id is that of a box."""
    if name in ("html", "body") or name in ARTICLE:
        return False
    return any(m[1].lower() in ("class", "id") and BOX.search(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest))


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in order: text between two block-level tags; and each named box's outer one or -1."""
    out: list[Block] = []
    outer: list[int] = []
    named = -1
    stack: list[tuple[str, bool, bool, int]] = []  # element, opens a box, opens an article, named box around it
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name lie
    boxes = articles = anchors = headings = 0
    current: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            current = Block(articles > 0, boxes > 0, named, heading=headings > 0)
        current.parts.append(text)
        if anchors:
            current.linked += len("".join(text.split()))

    def close() -> None:
        nonlocal current
        if current is not None and current.measure():
            out.append(current)
        current = None

    def pop(name: str, stops: frozenset[str]) -> None:
        nonlocal boxes, articles, named
        if not places.get(name):
            return
        i = places[name][-1]
        if any(places[stop][-1] > i for stop in stops if places.get(stop)):
            return
        named = stack[i][3]
        for inner, b, a, _ in stack[i:]:
            boxes, articles = boxes - b, articles - a
            places[inner].pop()
        del stack[i:]

    walls = frozenset(("article", "main", "section", "div", "body", "td", "nav", "aside", "footer", "header", "form"))
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            add(unescape(html[at:]))
            break
        add(unescape(html[at : m.start()]))
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, rest = m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if name in INLINE:
            if name == "a":
                anchors = 0 if end else 1
            elif name == "br":
                add(" ")
            continue
        close()
        anchors = 0
        if name in RAW and not end:
            over = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = over.end() if over else len(html)
            continue
        if re.fullmatch("h[1-6]", name):
            headings = 0 if end else 1
        if end:
            pop(name, walls if name == "p" else frozenset())
        else:
            if name in CLOSES_P:
                pop("p", walls)
            if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                pop(name, walls | {"ul", "ol", "table", "dl"})
            if name in VOID or rest.endswith("/"):
                continue
            b, a = box(name, rest, articles > 0), name in ARTICLE or bool(re.search(r"articleBody|role\s*=\s*[\"']?(?:main|article)\b", rest))
            boxes, articles = boxes + b, articles + a
            places.setdefault(name, []).append(len(stack))
            stack.append((name, b, a, named))
            if box_name(name, rest):
                outer.append(named)
                named = len(outer) - 1
    close()
    return out, outer


def label(block: Block, worded: bool) -> str:
    """good, bad, near or short; ``worded``: the page's stop words are known."""
    if block.boxed or block.linked > LINKS * block.size:
        return "bad"
    length = len(block.text)
    if block.article:
        # inside an article length or wording is enough; only short blocks wait for their neighbours
        return "short" if length < SHORT and block.share < MANY_STOPS else "good"
    if not worded:
        length += 2 * len(DENSE.findall(block.text))
        return "short" if length < SHORT else "good" if length > LONG else "near"
    if length < SHORT:
        return "short"
    if block.share >= MANY_STOPS:
        return "good" if length > LONG else "near"
    return "near" if block.share >= FEW_STOPS else "bad"


def open_named_boxes(found: list[Block], labels: list[str], outer: list[int]) -> None:
    """Mark as boxed what lies in a named box, unless the box is but a wrapper of the page's text.

    A wrapper holds most of the text, and most of what lies in articles or else nine
    tenths of all and is long: long comments on a shorter article are no wrapper, nor is
    an advert of a few words on a page of fewer.
    """
    inside, in_article = [0] * len(outer), [0] * len(outer)
    total = articles = 0
    for block, kind in zip(found, labels, strict=True):
        if kind in ("good", "near") or (block.article and kind == "short"):
            total, articles = total + block.size, articles + block.size * block.article
            if block.named >= 0:
                inside[block.named] += block.size
                in_article[block.named] += block.size * block.article
    for k in range(len(outer) - 1, -1, -1):
        if outer[k] >= 0:
            inside[outer[k]] += inside[k]
            in_article[outer[k]] += in_article[k]
    closed: list[bool] = []
    for k, around in enumerate(outer):
        alone = 10 * inside[k] >= 9 * total and inside[k] > LONG
        wrapper = 2 * inside[k] > total and (2 * in_article[k] > articles or alone)
        closed.append(not wrapper or (around >= 0 and closed[around]))
    for block in found:
        block.boxed = block.boxed or (block.named >= 0 and closed[block.named])


def settled(labels: list[str], found: list[Block], structured: bool) -> list[bool]:
    """Pass two: which blocks are text; those in articles and the others go by their own kind.  ``structured``: an article holds most of it."""
    n = len(labels)
    firm = {"good": True, "bad": False}
    # near blocks take the nearest firm label if both sides agree or one is good; short ones the nearest of all
    before: list[bool | None] = [None] * n
    after: list[bool | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[bool, bool] = {}
        for i in order:
            side[i] = last.get(found[i].article)
            if labels[i] in firm and not found[i].boxed:
                last[found[i].article] = firm[labels[i]]
    keep = []
    for i in range(n):
        if labels[i] in firm:
            keep.append(firm[labels[i]])
            continue
        around = [x for x in (before[i], after[i]) if x is not None]
        if found[i].article:
            keep.append(any(around) or not around)  # an article's short lines stay unless only link lists lie around
        elif labels[i] == "near":
            keep.append(any(around) or (not around and not structured))
        elif found[i].heading:
            keep.append(bool(after[i]))
        else:
            keep.append(bool(around) and all(around))
    return keep


def main_text(html: str | None) -> str:
    found, outer = blocks(html or "")
    prose = [b for b in found if not b.boxed and b.linked <= LINKS * b.size]
    # by characters: a paragraph without blanks is one word
    worded = sum(b.share * b.size for b in prose) >= FEW_STOPS * sum(b.size for b in prose)
    open_named_boxes(found, [label(b, worded) for b in found], outer)
    labels = [label(b, worded) for b in found]
    inside = sum(b.size for b, kind in zip(found, labels, strict=True) if kind != "bad" and b.article)
    outside = sum(b.size for b, kind in zip(found, labels, strict=True) if kind in ("good", "near") and not b.article)
    structured = inside > 0 and inside >= outside
    if structured and not worded:
        # length alone says too little against the article
        labels = [kind if b.article else "bad" for b, kind in zip(found, labels, strict=True)]
    return "\n".join(b.text for b, keep in zip(found, settled(labels, found, structured), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or blank page, and one without main text, gives the empty text.  Rows with a
    null or repeated page_id are treated one by one, an empty table gives an empty
    result, other columns are ignored.  Unclosed tags, quotes and comments end at the
    page's end.  A page is read whole, in time linear in its length however deep or broken
    its nesting, with some 500 bytes a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(html) for html in texts(part, "html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
