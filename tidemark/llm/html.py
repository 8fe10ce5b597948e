"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass scores every block: by its text (link
density, length, density of stop words) and by where it stands. Navigation, header, footer, sidebar, form
or an element whose class or id names a notice, advert, menu or comments count against it. So does a place
outside the page's main element; a place inside counts for it. The main element is the article or main
with the most good text, with any that has half as much; where more good text stands outside all of them,
the page has none. Articles named as comments or cards are elements like others. A block whose evidence
does not decide is left to the second pass. Inside the main element it stays, unless the nearest decided
blocks there are bad on both sides. Elsewhere it gets the label of the nearest decided blocks around it,
good where both sides are or on a tie.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import slices

BATCH_BYTES = 8 << 20
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.20, 0.30

#: Fixed names: HTML's void elements, block-level elements, elements never shown as text, and page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul""".split())
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas audio video select option textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
NOTES = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright disclaimer footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion
related respond sidebar share sharing social sponsor sponsored subscribe toolbar widget""".split())
#: What may stand beside a name of NOTES in one class or id, as in "site-footer" or "comment-body".
BESIDE = frozenset("""area bar block body bottom box container entry form global inner item items left links list main outer page panel
post posts right row section site slot text thread top unit wrap wrapper""".split())
CARDS = frozenset("card cards teaser teasers tile tiles".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

#: Frequent words of the languages at hand.
STOP = frozenset("""the of and to in a is that it for on was as with be by are at this from or an which not his have but they you
le la les de des du un une et en que qui est dans pour par sur au avec ce il ne pas plus se son sont
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus
el los las y que en un una por con no para su al es lo como más o pero sus""".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
#: A tag that the page's end cuts off is no text.
OPEN_TAG = re.compile(r"</?[A-Za-z][^<>]*\Z")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block:
    __slots__ = ("bad", "heading", "linked", "region", "text")

    def __init__(self, bad: bool, region: int, heading: bool) -> None:
        self.bad, self.region, self.heading, self.linked, self.text = bad, region, heading, 0, []


def names_of(attributes: str) -> Iterator[list[str]]:
    """The parts of every class, id and role."""
    for found in NAMED.finditer(attributes):
        value = next(v for v in found.groups() if v is not None)
        for name in value.lower().split():
            yield [part for part in re.split(r"[-_]+", name) if part and not part.isdigit()]


def is_note(attributes: str) -> bool:
    """Whether a whole name is a notice's: "ad-slot" is, "ad-free" and "share-price" are not."""
    return any(not NOTES.isdisjoint(parts) and all(part in NOTES or part in BESIDE for part in parts) for parts in names_of(attributes))


def is_card(attributes: str) -> bool:
    return any(parts and parts[-1] in CARDS for parts in names_of(attributes))


def blocks_of(page: str) -> list[Block]:
    """The page's text in blocks, in order, with what its surroundings say."""
    stack: list[tuple[str, bool, int, bool]] = []  # name, bad, outermost article or main, hidden, each with all that is around
    found: list[Block] = []
    block: Block | None = None
    links, regions, at, end = 0, 0, 0, len(page)
    opened: Counter[str] = Counter()

    def add(text: str) -> None:
        nonlocal block
        bad, region, hidden = stack[-1][1:] if stack else (False, 0, False)
        if hidden or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(bad, region, any(name in ("h1", "h2", "h3", "h4", "h5", "h6") for name, *_ in stack[-3:]))
            found.append(block)
        block.text.append(text)
        if links:
            block.linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal links
        for inner in stack[depth:]:
            opened[inner[0]] -= 1
            links -= inner[0] == "a"
        del stack[depth:]

    while at < end:
        tag = TAG.search(page, at)
        if tag is None:
            add(OPEN_TAG.sub("", page[at:end]))
            break
        add(page[at:tag.start()])
        at = tag.end()
        closing, name, attributes = tag.groups()[:3] if tag[2] else tag.groups()[3:]  # the latter: a quote left open
        name = (name or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                add(tag[0][9:-3])
            continue
        if name in BLOCK:
            block = None
        elif name in ("br", "img", "wbr") and name != "wbr":
            add(" ")
        if closing:
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P and any(inner[0] == "p" for inner in stack[-4:]):  # an open paragraph ends here
            depth = max(n for n, inner in enumerate(stack) if inner[0] == "p")
            close(depth)
        bad, region, hidden = stack[-1][1:] if stack else (False, 0, False)
        heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in FURNITURE or name == "header" or name not in ("html", "body", "main") and is_note(attributes):
            bad = True
        if name in ("article", "main") and not region and not bad and not (name == "article" and is_card(attributes)):
            regions += 1
            region = regions
        if heading and region and stack and stack[-1][0] == "header" and not any(inner[1] for inner in stack[:-1]):
            bad = False  # an article's own title
        stack.append((name, bad, region, hidden or name in HIDDEN))
        opened[name] += 1
        links += name == "a"
        if name in RAW:  # up to its end tag all is text
            finish = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = finish.end() if finish else end
            close(len(stack) - 1)
    return found


def main_text(page: str | None) -> str:
    """Main text of one page; empty where there is none."""
    found = blocks_of(page or "")
    texts = [" ".join(html.unescape("".join(block.text)).split()) for block in found]
    linked, says = [], []
    for block, text in zip(found, texts):
        words = text.lower().split()
        stop = sum(word.strip(".,;:!?") in STOP for word in words) / max(1, len(words))
        good = len(text) >= LONG and stop >= STOP_LOW or len(text) >= SHORT and stop >= STOP_HIGH
        linked.append(block.linked / max(1, sum(map(len, block.text))) > LINKS)
        says.append(2 if good else -1 if len(text) >= LONG else 0)
    main = main_regions(found, texts, linked, says)
    labels: list[bool | None] = []
    for block, text, links, score in zip(found, texts, linked, says):  # first pass
        inside = block.region in main
        score = -2 + (block.heading and inside) if links else score
        score += 1 if inside else -2 if main else 0
        score -= 4 * block.bad
        labels.append(False if not text or score < 0 else True if score >= 2 else None)
    before = nearest(found, labels, main, range(len(labels)))
    following = nearest(found, labels, main, range(len(labels) - 1, -1, -1))
    kept = []
    for at, label in enumerate(labels):  # second pass
        if label is None:
            sides = sorted((abs(place - at), not decided) for place, decided in filter(None, (before[at], following[at])))
            if found[at].region in main:
                label = len(sides) < 2 or not all(bad for _, bad in sides)
            else:
                label = bool(sides) and not sides[0][1] or found[at].heading and following[at] is not None and following[at][1]
        if label and texts[at]:
            kept.append(texts[at])
    if not kept:  # nothing told good from bad, as in short pages or other languages: all that is not bad by its place
        kept = [text for block, text, links in zip(found, texts, linked) if text and not links and not block.bad]
    return " ".join(kept)


def main_regions(found: list[Block], texts: list[str], linked: list[bool], says: list[int]) -> set[int]:
    """The articles and main elements that hold the page's text; none where more good text stands outside."""
    for least in (2, -1):  # by good text; where there is none at all, by any that is not of links
        sums: Counter[int] = Counter()
        for block, text, links, score in zip(found, texts, linked, says):
            if text and not links and not block.bad and score >= least:
                sums[block.region] += len(text)
        if sums:
            most = max((n for region, n in sums.items() if region), default=0)
            return {region for region, n in sums.items() if region and 2 * n >= most} if most >= sums[0] else set()
    return set()


def nearest(found: list[Block], labels: list[bool | None], main: set[int], order: range) -> list[tuple[int, bool] | None]:
    """For every block the last decided one in ``order``; inside a main element, the last one in it that is not bad by its place."""
    last: tuple[int, bool] | None = None
    inside: dict[int, tuple[int, bool]] = {}
    given: list[tuple[int, bool] | None] = [None] * len(labels)
    for at in order:
        block, label = found[at], labels[at]
        if label is not None:
            last = (at, label)
            if not block.bad:
                inside[block.region] = last
        given[at] = inside.get(block.region) if block.region in main else last
    return given


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html, ...)``.

    Null or empty html gives an empty text. Unclosed and stray tags are taken as they come. Repeated rows
    stay, an empty table gives an empty one, other columns are not read.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", BATCH_BYTES):
            found = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())],
                                             ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
