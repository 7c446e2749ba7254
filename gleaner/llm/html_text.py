"""Operator 9: the main text of a page by two passes of block rules.

A page is cut into blocks of running text. The first pass calls a block good or bad by its place, its length, its share of
link text and its density of stop words, or leaves it undecided; the second gives an undecided block the label of the nearest
decided block of its surroundings. Class names weigh in the first pass: a name of boilerplate rules a block out, a name that
only holds such a word asks more of it, and nothing at all within an article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags, class words and stop words.
#: Elements whose content is no text.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea option datalist".split())
#: Elements that hold boilerplate, wherever they stand.
AROUND = frozenset("nav footer aside form button dialog menu fieldset label".split())
#: Elements that hold the article.
INSIDE = frozenset("article main".split())
#: Elements that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation footer header masthead cookie cookies consent gdpr notice notification alert banner comment comments disqus replies discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget breadcrumb breadcrumbs pagination pager copyright skip toolbar complementary contentinfo search".split()
)
#: Marks of what readers wrote, also around an article.
READERS = frozenset("comment comments disqus replies discussion".split())
#: Words beside a mark that only say that something is held, and where, as in "footer-content".
HOLDERS = frozenset("content main inner outer wrap wrapper container box block body area section list item items text row col column panel group link links left right top bottom bar slot zone unit region holder posts articles stories form icon icons button buttons".split())
#: Words before a mark that say whose it is, as in "page-footer".
OWNERS = frozenset("site page global primary secondary post article entry user reader blog story".split())
#: Words that turn a mark around, as in "no-sidebar" or "content-with-sidebar".
TURNED = frozenset("no not without with has free hide hidden".split())
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its just like more most my no not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous y
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja man mit nach nicht noch nur ob oder sich sie sind so über um und uns vom von vor war was wenn wie wir zu zum zur
    al como con de del el ella en entre era es esta este fue ha hay la las lo los me muy más no nos o para pero por porque que se si sin sobre su sus también te todo un una uno ya y""".split()
)

#: Shorter blocks (characters) are undecided, longer ones than LONG are good with enough stop words.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?|[^<]+|<", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts that are written without spaces: a character of theirs counts as three.
_DENSE = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")


@dataclass
class Block:
    text: str
    link: int
    inside: bool
    around: bool
    heading: bool
    weak: bool = False
    label: str = ""


def _weight(name: str) -> tuple[int, frozenset[str]]:
    """How much a class name speaks of boilerplate, and its marks: 2 if it names some, 1 if a mark is but part of another
    thing's name, as in "related-work"; 0 else."""
    parts = [x.lower() for x in _PART.findall(name)]
    marks = MARKS.intersection(parts)
    if not marks or TURNED.intersection(parts):
        return 0, frozenset()
    rest = [x for x in parts if x not in HOLDERS]
    named = all(x in MARKS or x in OWNERS for x in rest) or rest[-1] in MARKS and "of" not in rest
    return (2 if named else 1), marks


def _marked(attributes: str) -> tuple[int, frozenset[str]]:
    """The weight of an element's class, id and role, and the marks of the names that have it."""
    most, marks = 0, frozenset()
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            w, found = _weight(name)
            most, marks = (w, found) if w > most else (most, marks | found if w == most else marks)
    return most, marks


class _Place(NamedTuple):
    """Where text stands: what the open elements say together."""

    tag: str = ""
    inside: bool = False
    #: Boilerplate by a tag or by readers' marks, also around an article; by other marks, since the last article began.
    fixed: bool = False
    named: bool = False
    weak: bool = False
    heading: bool = False
    anchor: bool = False


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in page order, in one pass. Elements left open are closed by the end of what holds them; the end
    of an inline element does not close the block around it."""
    out: list[Block] = []
    stack: list[_Place] = [_Place()]
    open_: dict[str, list[int]] = {}  # the places of the open elements of a tag on the stack
    walls: list[int] = [0]  # the places of the open block elements
    parts: list[str] = []
    links: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            link = len(" ".join(html.unescape("".join(links)).split()))
            at = stack[-1]
            out.append(Block(text, link, at.inside, at.fixed or at.named, at.heading, at.weak))
        parts.clear()
        links.clear()

    def close(place: int) -> None:
        while len(stack) > place:
            open_[stack.pop().tag].pop()
        while walls[-1] >= place:
            walls.pop()

    def begin(tag: str, attributes: str) -> None:
        up = stack[-1]
        weight, marks = _marked(attributes) if tag not in ("html", "body") else (0, frozenset())
        article = tag in INSIDE
        if up.inside or article:
            # A header in an article is the article's.
            marks -= {"header"}
            weight = weight if marks else 0
        fixed = up.fixed or tag in AROUND or (tag == "header" and not up.inside) or weight == 2 and bool(READERS & marks)
        # A marked wrapper around a whole article says nothing about the article.
        named = weight == 2 or up.named and not article
        weak = weight == 1 or up.weak and not article
        open_.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            walls.append(len(stack))
        stack.append(_Place(tag, up.inside or article, fixed, named, weak, up.heading or tag in HEADINGS, up.anchor or tag == "a"))

    at, headed, cdata = 0, False, page.rfind("]]>")
    while at < len(page):
        m = _TOKEN.match(page, at)
        start, at = at, m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                parts.append(m[0])
                if stack[-1].anchor:
                    links.append(m[0])
            elif m[0].startswith("<![CDATA[") and start < cdata:
                end = page.index("]]>", start)
                parts.append(html.escape(page[start + 9 : end]))
                at = end + 3
            continue
        tag = tag.lower()
        if tag in SILENT and not m[1]:
            if not m[3].endswith("/") and not (tag == "head" and headed):
                end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
                if tag == "head":
                    # An unclosed head must not swallow the page.
                    headed = True
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = min(end.end(), body.start() if body else end.end()) if end[0] or body else at
                else:
                    at = end.end()
            continue
        if tag in BLOCKS:
            flush()
        if m[1]:
            places = open_.get(tag)
            if places and (tag in BLOCKS or places[-1] > walls[-1]):
                close(places[-1])
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            if tag in ("p", "li") and stack[walls[-1]].tag == tag:
                close(walls[-1])
            begin(tag, m[3])
    flush()
    return out


def _size(text: str) -> int:
    """The length of a text as spaced scripts have it."""
    return len(text) + 2 * len(_DENSE.findall(text))


def _density(text: str) -> float:
    """The share of stop words among the words of a text."""
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def _first(b: Block, spoken: bool) -> str:
    """The label of a block by itself: good, bad or undecided (near: undecided, but much like text). ``spoken``: whether the page has stop
    words; of a page in another language length and links alone tell text."""
    if b.around or b.link > LINKS * len(b.text):
        return "bad"
    size = _size(b.text)
    if size < SHORT:
        return "bad" if (b.link or b.weak) and not b.inside else "short"
    density = _density(b.text) if spoken else STOP_HIGH
    if b.weak and not b.inside:
        # A name that may mark boilerplate asks for more: running text, and good neighbours.
        return "near" if size > LONG and density >= STOP_HIGH else "bad"
    if density >= STOP_HIGH:
        return "good" if size > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "short" if b.inside else "bad"


def classify(found: list[Block]) -> list[Block]:
    """Labels every block good or bad.

    Undecided blocks take the label of the nearest decided block with the same surroundings (inside or outside the
    article), the one before first among equals; a heading looks at what follows it. Where none is decided, blocks inside an
    article are good. Near blocks are good inside an article, and on a page without article if a neighbour is good. Where an
    article has good blocks, nothing outside it is good.
    """
    spoken = any(not b.around and _density(b.text) >= STOP_LOW for b in found if _size(b.text) >= SHORT)
    first = [_first(b, spoken) for b in found]
    article = any(b.inside and not b.around for b in found)
    for side in (True, False):
        mine = [i for i, b in enumerate(found) if b.inside == side]
        # Blocks that are bad by their place say nothing about the text beside them.
        tells = [first[i] if first[i] in ("good", "bad") and not found[i].around else "" for i in mine]
        before: list[tuple[int, str] | None] = []
        last: tuple[int, str] | None = None
        for n, t in enumerate(tells):
            last = (n, t) if t else last
            before.append(last)
        last = None
        for n in range(len(mine) - 1, -1, -1):
            b, kind = found[mine[n]], first[mine[n]]
            last = (n, tells[n]) if tells[n] else last
            near = [x for x in (before[n], last) if x]
            if kind in ("good", "bad"):
                b.label = kind
            elif kind == "near":
                b.label = "good" if side or not article and (not near or any(x[1] == "good" for x in near)) else "bad"
            elif not near:
                b.label = "good" if side else "bad"
            elif b.heading and last and last[1] == "good":
                b.label = "good"
            else:
                b.label = min(near, key=lambda x: abs(x[0] - n))[1]
    if any(b.inside and b.label == "good" for b in found):
        for b in found:
            b.label = b.label if b.inside else "bad"
    return found


def main_text(page: str | None) -> str:
    """The good blocks of a page in page order, joined by one space."""
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each row of ``pages`` (page_id, url, html).

    A null or empty page, and one without any good block, has the empty text. Pages of any length are read whole, cut-off
    pages as far as they go. Repeated rows give repeated results; an empty table gives an empty one; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
