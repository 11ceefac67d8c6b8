"""Main text of HTML pages by two passes of block rules.

The first pass cuts a page into blocks at block-level tags and decides each on stop-word
density, length, link density and the containers it stands in.  The second pass gives short
and undecided blocks the label of their nearest decided neighbours inside the same container.

Cases: null or empty HTML gives an empty text; markup cut off in mid-tag is dropped from its
``<`` on; unclosed containers last to the end of the page; repeated rows are read each on
their own; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.text import slices

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.08, 0.16
MAX_LINKS = 0.3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = frozenset("script style noscript template textarea select button svg canvas iframe object head title math audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_REPLY_WORDS = frozenset("comment comments disqus replies reply".split())
_MAIN = frozenset("article main".split())
#: common function words of the languages read
STOP_WORDS = frozenset((
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se son sont sur un une vous "
    "als am auch auf aus bei bis das dass dem den der des die durch ein eine einen er es für haben hat ich im ist mit nach nicht noch oder sich sie sind über um und von vor war wie wird zu zum zur "
    "al como con del el ella ellos en entre era es esta este fue ha la las lo los más me muy no para pero por que se sin sobre su sus una y ya").split())


@dataclass
class Block:
    text: str
    links: int          # characters inside links
    verdict: str        # good, bad, near, short
    room: int           # the container whose blocks may lend a label
    article: bool


def _decide(text: str, links: int, aside: int, heading: bool, article: bool) -> str:
    size = len(text)
    if aside or links > MAX_LINKS * size:
        return "bad"
    if heading or size < SHORT:
        return "short"
    found = _WORD.findall(text)
    density = sum(w.lower() in STOP_WORDS for w in found) / max(1, len(found))
    if density >= MANY_STOPS or (density >= FEW_STOPS and size >= LONG):
        return "good"
    if density >= FEW_STOPS or article:
        return "near"
    return "bad"


def blocks(page: str) -> list[Block]:
    """First pass: the blocks of a page in order, each with its own verdict."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, int]] = []       # tag, hidden, aside (2: by tag or comments), article, room
    hidden, aside, article, room, rooms = False, 0, False, 0, 0
    text: list[str] = []
    linked: list[str] = []
    link, heading, breaks, pos = 0, False, 0, 0

    def close():
        nonlocal heading, breaks
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            inner = len(" ".join(entities.unescape("".join(linked)).split()))
            out.append(Block(line, inner, _decide(line, inner, aside, heading, article), room, article))
        text.clear()
        linked.clear()
        heading, breaks = False, 0

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        piece = page[pos:m.start() if m else len(page)]
        if piece and not hidden:
            cut = re.search(r"<[a-zA-Z/][^>]*\Z", piece) if not m else None
            piece = piece[:cut.start()] if cut else piece
            text.append(piece)
            if link:
                linked.append(piece)
            breaks = breaks if not piece.strip() else 0
        if not m:
            break
        pos = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                link = max(0, link - 1)
            if tag in _BLOCK:
                close()
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                _, hidden, aside, article, room = stack[at]
                del stack[at:]
            continue
        if tag in _RAW and not m.group(3).rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            if tag in _BLOCK:
                close()
            continue
        if tag == "br":
            text.append(" ")
            breaks += 1
            if breaks > 1:
                close()
        elif tag in _BLOCK:
            close()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag == "a":
            link += 1
        if tag in _VOID or m.group(3).rstrip().endswith("/"):
            continue
        if tag in _BLOCK or tag in _HIDDEN:
            stack.append((tag, hidden, aside, article, room))
            marks = {w for g in _MARK.findall(m.group(3)) for w in re.split(r"[^a-z]+", "".join(g).lower())}
            hidden = hidden or tag in _HIDDEN or bool(re.search(r"\bhidden\b|display\s*:\s*none", m.group(3)))
            if tag in _MAIN:
                # a layout class around the article does not count against it; a comment section does
                article, rooms, aside = True, rooms + 1, aside * (aside > 1)
                room = rooms
            if tag in _ASIDE or (tag == "header" and not article) or marks & _REPLY_WORDS:
                aside = 2
            elif tag not in ("body", "html") and marks & _ASIDE_WORDS:
                aside = max(aside, 1)
    close()
    return out


def main_text(page: str | None) -> str:
    """Second pass: undecided blocks inherit, good ones are joined."""
    found = blocks(page or "")
    labels = [b.verdict for b in found]
    # nearest decided block on either side, with its distance, inside the same container
    near: list[list[tuple[int, str]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, str]] = {}
        for k in order:
            b = found[k]
            if labels[k] in ("good", "bad") and not (b.article and labels[k] == "bad"):
                last[b.room] = (k, labels[k])
            elif b.room in last:
                at, label = last[b.room]
                near[k].append((abs(k - at), label))
    kept = []
    for k, b in enumerate(found):
        label = labels[k]
        if label in ("short", "near"):
            sides = sorted(near[k])
            if not sides:
                label = "good" if b.article else "bad"
            elif len(sides) == 2 and sides[0][0] == sides[1][0] and sides[0][1] != sides[1][1]:
                label = "good" if b.article or label == "near" else "bad"
            else:
                label = sides[0][1]
        if label == "good":
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
