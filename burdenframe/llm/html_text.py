"""Main text of HTML pages by two passes of block rules.

The first pass labels each block by stop-word density, length and link density; some stay undecided, mostly short ones.
In the second pass those take the label of the nearest decided neighbours. Elements made for other things than the text
(menus, footers, side bars, forms, comments, adverts) are rejected by their tag, role or class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from burdenframe.llm.common import batches, only, record_batch, slices

LONG = 70
MIN_STOP_SHARE = 0.1
MAX_LINK_SHARE = 0.5
#: Fixed list of frequent words in the languages of the corpus.
STOP_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se sur un une "
    "auf aus das dem den der des die ein eine einer es für im ist mit nicht sich sie und von wie zu "
    "al como con del el ella es la las lo los más no para pero por que se su sus un una y".split()
)
#: Fixed lists of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea iframe svg math object xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("aside button dialog footer form head menu nav option select title".split())
TEXT = frozenset(("article", "main"))
#: Fixed words in class, id or role that mark what isn't the text.
MARKS = frozenset(
    "ad ads adv advert advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog "
    "disqus footer masthead menu nav navbar navigation newsletter notice pagination popup promo related replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe widget".split()
)
#: Marks of lists that are themselves made of article elements, which are not the page's own.
LISTS = frozenset("comment comments disqus related replies respond".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
GOOD, BAD, OPEN = 1, -1, 0
#: Why an element is rejected: not at all, by class around an article of such a list, by class of a list, by class, by tag or hidden.
KEPT, DOUBTFUL, LISTED, CLASSED, SURE = range(5)


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    rejected: int
    part: int  # number of the article or main element that it is in, 0 outside


def _marked(attributes: str) -> int:
    if not attributes.strip():
        return KEPT
    if _HIDDEN.search(re.sub(r""""[^"]*"|'[^']*'""", lambda m: m[0] if ":" in m[0] else '""', attributes)):
        return SURE
    words = {w for m in _MARK.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return KEPT if MARKS.isdisjoint(words) else CLASSED if LISTS.isdisjoint(words) else LISTED


def blocks(html: str) -> list[Block]:
    """Stretches of text between block elements, with white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, why it is rejected, article
    open_at: dict[str, list[int]] = {}  # where each element, and as "" any block, is in the stack
    texts: list[tuple[str, bool]] = []
    parts = anchors = at = 0

    def close() -> None:
        text = " ".join(unescape("".join(t for t, _ in texts)).split())
        if text:
            linked = len(" ".join(unescape("".join(t for t, link in texts if link)).split()))
            out.append(Block(text, linked, stack[-1][1] if stack else KEPT, stack[-1][2] if stack else 0))
        texts.clear()

    def push(name: str, lost: int, part: int) -> None:
        for k in (name, "") if name in BLOCKS else (name,):
            open_at.setdefault(k, []).append(len(stack))
        stack.append((name, lost, part))

    def pop() -> None:
        name = stack.pop()[0]
        for k in (name, "") if name in BLOCKS else (name,):
            open_at[k].pop()

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at:
            texts.append((html[at:lt], anchors > 0))
        if lt == len(html):
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if m is None:
            if not re.match(r"<[a-zA-Z/!?]", html[lt : lt + 2]):
                texts.append(("<", anchors > 0))  # a plain sign
                at = lt + 1
            else:
                end = html.find(">", lt)
                at = len(html) if end < 0 else end + 1
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = len(html) if end is None else end.end()
            continue
        if name == "a":
            anchors = max(0, anchors - 1) if closing else 1
        if name == "br":
            texts.append((" ", anchors > 0))
        if name in BLOCKS:
            close()
            anchors = 0 if name != "a" else anchors
        if name in VOID:
            continue
        if closing:
            own, inner = open_at.get(name), open_at.get("")
            if own and (name in BLOCKS or not inner or inner[-1] < own[-1]):  # an inline element does not end the blocks inside it
                for _ in range(len(stack) - own[-1]):
                    pop()
            continue
        if name in BLOCKS:
            while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCKS):
                pop()
        rejected, part = (stack[-1][1], stack[-1][2]) if stack else (KEPT, 0)
        inside = part > 0
        if name in TEXT and not part:
            parts += 1
            part = parts
        lost = rejected
        if name in NOT_TEXT or name == "header" and not part:
            lost = SURE
        elif name in TEXT and rejected in (CLASSED, LISTED):
            own = _marked(attributes)
            lost = SURE if own == SURE else DOUBTFUL if own or inside or rejected == LISTED and name != "main" else KEPT
        elif name not in TEXT | {"html", "body"} and lost != SURE:
            own = _marked(attributes)
            if own == SURE or own and lost == DOUBTFUL:
                lost = SURE
            elif own == LISTED or lost == KEPT:
                lost = own
        if name in BLOCKS or lost != rejected:
            if lost != rejected and name not in BLOCKS:
                close()
            push(name, lost, part)
    close()
    return out


def first_pass(block: Block) -> int:
    if block.linked > MAX_LINK_SHARE * len(block.text):
        return BAD
    if len(block.text) < LONG:
        return OPEN
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    return GOOD if share >= MIN_STOP_SHARE else OPEN


def main_text(html: str | None) -> str:
    """The text of the blocks that are kept, joined by line breaks. Blocks of rejected elements go first. An article or main element ends a
    rejection by the class of what is around it, as of a layout with a side bar; in lists of comments or related pages, inside another
    article or with such a class itself, it does so only if the page has no other article or main text. Labels don't pass the bounds of an article or main
    element; inside one, blocks without any decided neighbour are kept, outside they are dropped. Of two decided neighbours as
    near, the later one counts."""
    found = blocks(html or "")
    only_doubtful = not any(b.part and b.rejected == KEPT for b in found)
    found = [b for b in found if b.rejected == KEPT or b.rejected == DOUBTFUL and only_doubtful]
    labels = [first_pass(b) for b in found]
    before, after = list(labels), list(labels)
    gap_before, gap_after = [0] * len(found), [0] * len(found)
    for i in range(1, len(found)):
        if not before[i] and found[i].part == found[i - 1].part:
            before[i], gap_before[i] = before[i - 1], gap_before[i - 1] + 1
    for i in range(len(found) - 2, -1, -1):
        if not after[i] and found[i].part == found[i + 1].part:
            after[i], gap_after[i] = after[i + 1], gap_after[i + 1] + 1
    kept = []
    for i, block in enumerate(found):
        near = labels[i]
        if not near:
            near = after[i] if after[i] and (not before[i] or gap_after[i] <= gap_before[i]) else before[i]
            if block.part and not near:
                near = GOOD
        if near == GOOD:
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page; the text is empty if there is none, as for null, empty or broken pages.

    Every row is read alone and whole, so repeated rows get equal texts; an empty table gives an empty table; other columns are left out.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            pages = batch.column("html").to_pylist()
            for lo, hi in batches(pages, 4_000_000):
                part = batch.slice(lo, hi - lo)
                yield record_batch(schema, part.column("page_id"), part.column("url"), [main_text(h) for h in pages[lo:hi]])

    return only(pages, page_id=page_id, url=url, html=html).mapInArrow(run, "page_id long, url string, text string")
