"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass decides blocks by link density, length and stop-word
density, with the structure they stand in as a prior; short or odd blocks stay undecided. In the second pass these
inherit the label of their nearest decided neighbours, but not from within an element that says it is no article.
A heading takes the label of what follows it. The trunk is the smallest container of nearly all prose, or the
article; a block in a container beside the trunk hears only its neighbours beside the trunk, so short text before or
after an article doesn't inherit from it, whatever its class is called.
Prose is a long block with many stop words and few links. An element that says its content is no article is not
believed when most of the page's prose stands in it and no article outside; an article without prose is a card when
there is prose outside of it.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.shared import ready

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|title|noframes"
OUTSIDE = frozenset("nav footer aside form button select dialog menu head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that mark what is no article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright dialog discussion disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup privacy promo promotion promoted recommended related replies reply respond search share sharing sidebar signin signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond feedback".split())
#: Frequent words of English, French, German and Spanish.
STOPS = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on or our she so some than that the their them there they this to was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über und uns vom von vor war wie wir zu zum zur "
    "al como con del el ella ellos era es esta este fue ha hay las lo los más me mi muy nos o para pero por ser si sin sobre su sus también te tiene todo y ya".split()
)
LONG, SHORT, LINKS, STOP_SHARE = 200, 70, 0.34, 0.1
#: Share of a page's prose that its trunk holds.
TRUNK = 0.8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block-level elements that are paragraphs; the others are containers.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption address summary legend hr".split())

_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Name and value of one attribute after another, so that no name is found within another name or a value.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _mark(tag: str, attrs: str) -> str:
    """What an element says of its content: 'hidden', 'readers', 'out', 'in', 'weak' or nothing.

    A name in class or id that is made of hints alone (ad, cookie-banner) says 'out', one with other words too (search-results) only 'weak'.
    """
    names: set[str] = set()
    strong = False
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "hidden"
            if name == "role":
                if value in ROLES:
                    return "out"
                if value in ("main", "article"):
                    return "in"
            elif name in ("class", "id"):
                for word in value.split():
                    parts = _NAME.findall(word)
                    names.update(parts)
                    strong = strong or bool(parts) and HINTS.issuperset(parts)
    if tag in OUTSIDE:
        return "out"
    if tag in ("html", "body", "main"):
        return "in" if tag == "main" else ""
    if names & READERS:
        return "readers"
    if tag == "article":
        return "in"
    if tag in HEADINGS or tag in ("b", "i", "em", "strong") or not names & HINTS:
        return ""
    return "out" if strong else "" if tag in ("span", "a") else "weak"


class Marked:
    """The marked elements of a page as a tree: each has a mark and the number of the marked element around it, -1 for none."""

    def __init__(self) -> None:
        self.up: list[int] = []
        self.mark: list[str] = []

    def add(self, up: int, mark: str) -> int:
        self.up.append(up)
        self.mark.append(mark)
        return len(self.up) - 1


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    at: int  # innermost marked element
    box: int  # innermost container, -1 for none
    tag: str  # innermost block-level element


def blocks(page: str) -> tuple[list[Block], Marked, list[int]]:
    """The blocks in order, the marked elements, and the container around each container."""
    out: list[Block] = []
    marked = Marked()
    boxes: list[int] = []
    text: list[str] = []
    linked = depth_a = 0
    stack: list[tuple[str, int, int]] = []  # open elements, with the marked element and the container around each
    open_: dict[str, int] = {}
    inner = box = -1

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, linked, inner, box, stack[-1][0] if stack else ""))
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if depth_a:
            linked += len(piece.strip())

    def pop() -> str:
        nonlocal inner, box
        tag, inner, box = stack.pop()
        open_[tag] -= 1
        return tag

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m["end"]:
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            if open_.get(tag):
                if text and tag not in BLOCKS:  # an inline element that is marked ends
                    flush()
                while pop() != tag:
                    pass
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag == "a":
            depth_a = 1
        mark = _mark(tag, m["attrs"])
        if tag == "header":
            mark = mark or ("" if inner >= 0 and marked.mark[inner] == "in" else "out")
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            pop()
        if tag in BLOCKS or mark:
            if mark:
                flush()
            stack.append((tag, inner, box))
            open_[tag] = open_.get(tag, 0) + 1
            if tag in BLOCKS and tag not in PARAGRAPHS:
                boxes.append(box)
                box = len(boxes) - 1
            if mark:
                inner = marked.add(inner, mark)
    if at < len(page):
        add(page[at:])
    flush()
    return out, marked, boxes


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOPS for w in words) / max(1, len(words))


def states(found: list[Block], marked: Marked, prose: list[bool]) -> list[str]:
    """'in', 'out', 'card', 'weak' or '' of each block: its prior. Takes time in proportion to blocks and marked elements."""
    up, mark, n = marked.up, marked.mark, len(marked.up)
    hidden, bad, inside, article = [False] * n, [False] * n, [False] * n, [False] * n  # inside: around a block in an article of its own
    for i in range(n):  # elements come after those around them
        hidden[i] = mark[i] == "hidden" or up[i] >= 0 and hidden[up[i]]
        bad[i] = mark[i] not in ("in", "weak") or up[i] >= 0 and bad[up[i]]
        article[i] = mark[i] == "in" or up[i] >= 0 and article[up[i]]
    held, used = [0] * n, [False] * n  # characters of prose, or of text on a page without prose, in each element; whether it has blocks
    total, any_prose = 0, any(prose)
    for b, good in zip(found, prose, strict=True):
        if b.at >= 0:
            used[b.at] = True
        if b.at >= 0 and hidden[b.at] or any_prose and not good:
            continue
        total += len(b.text)
        if b.at >= 0:
            held[b.at] += len(b.text)
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            held[up[i]] += held[i]
            used[up[i]] = used[up[i]] or used[i]
            inside[up[i]] = inside[up[i]] or inside[i] or used[i] and mark[i] == "in"
    if not any(b.at >= 0 and article[b.at] and not bad[b.at] for b in found):  # no article outside of elements that say they are none
        for i in range(n):
            if mark[i] in ("in", "weak"):
                believed = False
            elif mark[i] == "hidden":
                believed = True
            elif not any_prose:
                believed = held[i] < total or not inside[i]
            else:
                believed = held[i] * 2 <= total if mark[i] == "out" else held[i] < total
            bad[i] = believed or up[i] >= 0 and bad[up[i]]
    held_in, weak = [False] * n, [False] * n
    for i in range(n):
        held_in[i] = mark[i] == "in" and held[i] > 0 or up[i] >= 0 and held_in[up[i]]
        weak[i] = mark[i] == "weak" and held[i] * 2 <= total or up[i] >= 0 and weak[up[i]]
    outside = any(good and (b.at < 0 or not bad[b.at] and not article[b.at]) for b, good in zip(found, prose, strict=True))

    def state(at: int) -> str:
        if at < 0:
            return ""
        if bad[at]:
            return "out"
        if article[at]:
            return "card" if outside and not held_in[at] else "in"
        return "weak" if weak[at] else ""

    return [state(b.at) for b in found]


def beside(found: list[Block], boxes: list[int], weight: list[int], paragraphs: bool) -> list[bool]:
    """Whether each block stands in a container that is neither in the trunk nor around it. weight: characters by which the trunk is found.

    paragraphs: where most of the weight stands in containers themselves and not in paragraphs, these are the page's paragraphs.
    """
    n, total = len(boxes), sum(weight)
    direct = sum(w for w, b in zip(weight, found, strict=True) if b.tag in PARAGRAPHS)
    box = [b.box if b.box < 0 or b.tag in PARAGRAPHS or not paragraphs or direct * 2 >= total else boxes[b.box] for b in found]
    held = [0] * n
    for w, i in zip(weight, box, strict=True):
        if i >= 0:
            held[i] += w
    for i in range(n - 1, -1, -1):
        if boxes[i] >= 0:
            held[boxes[i]] += held[i]
    trunk = -1  # the last of those that hold enough is the innermost, as TRUNK is over a half
    for i in range(n):
        if held[i] >= TRUNK * total > 0:
            trunk = i
    if trunk < 0:
        return [False] * len(found)
    around, within = {trunk, -1}, [False] * n
    i = trunk
    while i >= 0:
        i = boxes[i]
        around.add(i)
    for i in range(n):
        within[i] = i == trunk or boxes[i] >= 0 and within[boxes[i]]
    return [i not in around and not within[i] for i in box]


def decided(found: list[Block], priors: list[str], prose: list[bool], dense: list[bool], shares: list[float], off: list[bool]) -> list[bool | None]:
    """The first pass: whether a block belongs to the main text, None if neither prior nor density says so. Beside the trunk only prose is sure."""
    article = "in" in priors
    label: list[bool | None] = []
    for i, (b, state) in enumerate(zip(found, priors, strict=True)):
        n = len(b.text)
        if state == "out":
            label.append(False)
        elif prose[i]:
            label.append("\xa9" not in b.text or state == "in")
        elif state == "in":  # links that stand together are a list, one alone can be a heading
            listed = dense[i] and (n >= SHORT or any(0 <= j < len(found) and dense[j] and priors[j] == "in" for j in (i - 1, i + 1)))
            label.append(False if listed else None if dense[i] else True)
        elif state in ("card", "weak") or dense[i] or "\xa9" in b.text or n < SHORT and (b.linked or article):
            label.append(False)
        elif n < SHORT or article:
            label.append(None if n < SHORT or shares[i] >= STOP_SHARE else False)
        else:
            label.append(True if n >= LONG or shares[i] >= STOP_SHARE and not off[i] else None)
    return label


def inherited(label: list[bool | None], speaks: list[bool], off: list[bool], heading: list[bool], alone: bool) -> list[bool]:
    """The second pass: undecided blocks take the label of the nearest decided block that speaks; the article wins a tie.

    A heading takes that of the next one. off: blocks beside the trunk, which hear all decided blocks beside it and
    no others; where there is none, they take alone or, if that is not given, listen as the others do.
    """

    def nearest(heard: list[bool]) -> list[tuple[int | None, int | None]]:
        left: list[int | None] = []
        last = None
        for i, x in enumerate(heard):
            left.append(last)
            last = i if x else last
        both: list[tuple[int | None, int | None]] = []
        last = None
        for i in range(len(heard) - 1, -1, -1):
            both.append((left[i], last))
            last = i if heard[i] else last
        return both[::-1]

    known = [x is not None for x in label]
    all_, own = nearest([a and b for a, b in zip(known, speaks, strict=True)]), nearest([a and b for a, b in zip(known, off, strict=True)])
    result = []
    for i, x in enumerate(label):
        if x is not None:
            result.append(x)
            continue
        left, right = all_[i]
        if off[i] and not heading[i]:
            if own[i] != (None, None):
                left, right = own[i]
            elif alone:
                result.append(False)
                continue
        if left is None and right is None:
            result.append(True)
        elif left is None or right is None:
            result.append(bool(label[right if left is None else left]))
        elif heading[i]:
            result.append(bool(label[right]))
        else:
            gap = (i - left) - (right - i)
            result.append(bool(label[left] if gap < 0 else label[right] if gap > 0 else label[left] or label[right]))
    return result


def classified(found: list[Block], marked: Marked, boxes: list[int]) -> list[bool]:
    """Whether each block belongs to the main text."""
    dense = [b.linked > LINKS * len(b.text) for b in found]
    shares = [stop_share(b.text) if len(b.text) >= SHORT else 0.0 for b in found]
    prose = [len(b.text) >= LONG and share >= STOP_SHARE and not d for b, share, d in zip(found, shares, dense, strict=True)]
    priors = states(found, marked, prose)
    article, any_prose = "in" in priors, any(prose)
    # An element that says its content is no article, or a card, ends where it ends: its blocks speak for no others.
    speaks = [state in ("", "in") for state in priors]
    weight = [0 if state not in ("", "in") or d or "\xa9" in b.text or article and state != "in" or any_prose and not article and not good else len(b.text) for b, state, d, good in zip(found, priors, dense, prose, strict=True)]
    off = beside(found, boxes, weight, not article)
    label = decided(found, priors, prose, dense, shares, off)
    return inherited(label, speaks, off, [b.tag in HEADINGS for b in found], article)


def main_text(page: str) -> str:
    """The blocks of the main text, joined by single spaces."""
    found, marked, boxes = blocks(page)
    return " ".join(b.text for b, good in zip(found, classified(found, marked, boxes), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    A null page is empty, and its text too. Rows that repeat are extracted each; null ids and urls are kept; other
    columns are ignored. Pages are read whole, however long or broken: what follows an unclosed comment is a comment.
    """
    ready(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = pages.select("page_id", "url").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids) + ", text string"

    def scan(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(scan, schema).withColumn("n_chars", F.length("text").cast("long"))
