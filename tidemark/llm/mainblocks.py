"""Main text of web pages by minimum-cut labelling of their blocks (operator 3).

A page is cut into blocks of text at block-level tags. A linear classifier turns what is known of a block
(marks on its ancestors, share of link text, length, punctuation, copyright signs) into a score s; the costs of
the labels, log(1 + exp(-s)) for content and log(1 + exp(s)) for the rest, are the terminal capacities.
Blocks next to each other in the page, and next to each other under one parent or grandparent, are joined
by edges whose capacity is the price of labelling them differently. The minimum cut is the cheapest
labelling. A block whose costs differ by more than all its edges weigh keeps its label in every minimum
cut; such blocks are settled first and their edges become costs of their neighbours, which is exact and
leaves few blocks for the maximum flow.

Pages are rows, each labelled within its task; there is no shuffle.

Defined cases: null or empty html gives empty text; text outside any tag is a block; comments, titles,
scripts, styles and other raw elements are not text; a script, style, textarea or title that never ends reaches to
the page's end, of any other raw element without an end only the tag is skipped, and an svg or math tag that ends
in a slash is empty; the tags of a head are ignored, so that text or tags which can't be in one belong to the page, as in
HTML; the text of math is text; unclosed tags end with their parent; character references are decoded, unknown
ones are left as they are. Extra columns are kept; those named like a result column are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unpacked

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>]+\Z")
_PART = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea select svg iframe object canvas audio video title xmp noembed noframes".split())
_RAW_TEXT = frozenset("script style noscript textarea iframe title xmp noembed noframes".split())  # end at the first end tag, whatever they hold; others may hold their own kind
_RAW_TO_END = frozenset("script style textarea title".split())  # reach to the end of the page if they never end
_MATH = frozenset("""annotation annotation-xml maction menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub
    msubsup msup mtable mtd mtext mtr munder munderover none semantics""".split())
_INLINE = _MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
_KEEPS_IN = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
#: Marks of an element: its tag, its role, or a word of its class or id.
REST_TAGS = {"nav": 10.0, "footer": 10.0, "aside": 10.0, "header": 8.0, "form": 10.0, "menu": 10.0, "dialog": 10.0, "button": 10.0, "fieldset": 10.0, "search": 10.0}
REST_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
REST_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    dialog disclaimer disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond
    search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split())
LAYOUT_WORDS = frozenset("layout wrapper wrap container page site with has no main row grid".split())  # such an element holds the page, whatever else it is called
TEXT_TAGS = frozenset(["article", "main"])
TEXT_WORDS = frozenset("article articlebody story post entry content".split())
_OPENS_TEXT = frozenset(["nav", "header", "footer", "menu"])  # an article inside one of these means that its end tag is missing
NEXT, SAME_PARENT, SAME_GRANDPARENT = 0.5, 0.6, 0.25


class _Element:
    __slots__ = ("tag", "number", "mark", "sticky")

    def __init__(self, tag: str, number: int, mark: float, sticky: bool):
        self.tag, self.number, self.mark, self.sticky = tag, number, mark, sticky


def _marked(tag: str, attributes: str, above: _Element) -> tuple[float, bool]:
    """The mark inherited by what is inside: negative for the rest, positive for the article; and whether an article inside can't undo it."""
    own, sticky = 0.0, False
    if tag in REST_TAGS and not (tag == "header" and above.mark > 0):
        own, sticky = -REST_TAGS[tag], tag not in _OPENS_TEXT and tag != "form"
    elif tag in TEXT_TAGS:
        own = 4.0
    if attributes and ("=" in attributes):
        named = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = (values[0] or values[1] or values[2]).lower()
            name = name.lower()
            if name in ("class", "id"):
                for one in value.split():
                    parts = set(_PART.findall(one))
                    if not parts & LAYOUT_WORDS:
                        named |= parts
            elif name == "role":
                if value in REST_ROLES:
                    own, sticky = -10.0, True
                elif value in ("main", "article"):
                    own = max(own, 4.0)
            elif name == "itemprop" and value == "articlebody":
                own = max(own, 4.0)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                own, sticky = -10.0, True
        if tag not in ("body", "html", "main") and named & REST_WORDS:
            own, sticky = -10.0, True
        elif own == 0.0 and named & TEXT_WORDS:
            own = 3.0
    if above.sticky or own == 0.0:
        return above.mark, above.sticky
    return own, sticky


def _empty(tag: str, attributes: str) -> bool:
    """Whether a tag of svg or math ends in a slash that is not part of an attribute's value."""
    return tag in ("svg", "math") and attributes.endswith("/") and not _BARE_VALUE.search(attributes)


def _text_end(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where the raw text of a tag that ends at `at` ends; `endless` remembers tags that no end tag follows."""
    found = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    if found:
        return found.end()
    endless.add(tag)
    return len(page) if tag in _RAW_TO_END else at


def _raw_ends(page: str) -> dict[int, int]:
    """Where the raw elements that may hold their own kind end, by where they start; those that never end are left out."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    endless: set[str] = set()
    at = 0
    while found := _TOKEN.search(page, at):
        at = found.end()
        closing, tag = found.group(1), (found.group(2) or "").lower()
        if tag in _RAW_TEXT:
            at = at if closing else _text_end(page, tag, at, endless)
        elif tag in _RAW and closing:
            if opened.get(tag):
                ends[opened[tag].pop()] = at
        elif tag in _RAW and not _empty(tag, found.group(3)):
            opened.setdefault(tag, []).append(found.start())
    return ends


def page_blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, score, parent, grandparent) of every block of text, in page order."""
    root = _Element("", 0, 0.0, False)
    stack = [root]
    out: list[tuple[str, float, int, int]] = []
    parts: list[str] = []
    linked, in_link, number = 0, 0, 0
    endless: set[str] = set()
    ends: dict[int, int] | None = None

    def end_block() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                holder = len(stack) - 1
                while holder and stack[holder].tag in _INLINE:
                    holder -= 1
                out.append((text, _score(text, linked, stack[holder].tag, stack[holder].mark), stack[max(holder - 1, 0)].number, stack[max(holder - 2, 0)].number))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            run = page[at:stop]
            parts.append(run)
            if in_link:
                linked += len(run.strip())
        if not found:
            break
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if not closing:
            if tag in _RAW:
                if tag in _RAW_TEXT:
                    at = _text_end(page, tag, at, endless)
                elif not _empty(tag, found.group(3)):
                    ends = _raw_ends(page) if ends is None else ends
                    at = ends.get(found.start(), at)
                if tag != "svg":
                    parts.append(" ")
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in _MATH:
                parts.append(" ")
            if _empty(tag, found.group(3)):
                continue
            if tag not in _INLINE:
                end_block()
                closes = ("p",) if tag in _ENDS_P else _SELF_CLOSING.get(tag, ())
                fences = _KEEPS_IN.get(tag, ("button", "td", "th", "table", "article", "section", "div"))
                k = len(stack) - 1
                while closes and k > 0 and stack[k].tag not in fences:
                    if stack[k].tag in closes:
                        if any(e.tag == "a" for e in stack[k:]):
                            in_link = 0
                        del stack[k:]
                    k -= 1
            if tag in _VOID or tag == "head":
                continue
            if tag in TEXT_TAGS:
                while len(stack) > 1 and stack[-1].tag in ("nav", "header", "footer", "menu", "ul", "ol", "li", "p") and any(e.tag in _OPENS_TEXT for e in stack):
                    stack.pop()
            number += 1
            mark, sticky = _marked(tag, found.group(3), stack[-1])
            stack.append(_Element(tag, number, mark, sticky))
            in_link += tag == "a"
        else:
            if tag not in _INLINE:
                end_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(e.tag not in _INLINE for e in stack[k:]):
                        end_block()
                    in_link -= sum(e.tag == "a" for e in stack[k:])
                    in_link = max(in_link, 0)
                    del stack[k:]
                    break
    end_block()
    return out


def _score(text: str, linked: int, tag: str, mark: float) -> float:
    words = text.count(" ") + 1
    share = min(linked / len(text), 1.0)
    s = mark - 0.8 + min(1.6, 0.4 * math.log2(words)) - 3.5 * share
    if tag in ("p", "blockquote", "pre", "h1", "h2", "h3"):
        s += 0.8
    if text[-1] in ".!?:;\"')…”":
        s += 0.6
    if "©" in text or "all rights reserved" in text.lower():
        s -= 2.5
    return s


def _edges(blocks: list[tuple[str, float, int, int]]) -> dict[tuple[int, int], float]:
    held: dict[tuple[int, int], float] = {}
    last: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for k, (_, _, parent, grand) in enumerate(blocks):
        near = [(k - 1, NEXT)] if k else []
        for seen, own, price in ((last[0], parent, SAME_PARENT), (last[1], grand, SAME_GRANDPARENT)):
            if own in seen:
                near.append((seen[own], price))
            seen[own] = k
        for j, price in near:
            held[j, k] = held.get((j, k), 0.0) + price
    return held


def cheapest_labels(content: list[float], rest: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (true: content) of least total cost: content[i] or rest[i] of each node, and an edge's price where its ends differ."""
    n = len(content)
    lean = [rest[i] - content[i] for i in range(n)]  # what the label content saves
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), price in edges.items():
        around[a][b] = around[a].get(b, 0.0) + price
        around[b][a] = around[b].get(a, 0.0) + price
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) > sum(around[i].values()):
            label[i] = lean[i] > 0
            for j, price in around[i].items():
                lean[j] += price if label[i] else -price
                del around[j][i]
                todo.append(j)
            around[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        side = _source_side({i: lean[i] for i in left}, {i: around[i] for i in left})
        for i in left:
            label[i] = i in side
    return [bool(x) for x in label]


def _source_side(lean: dict[int, float], around: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut: the source feeds nodes that lean to content, the others drain; level graphs and blocking flows."""
    s, t = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(held) for i, held in around.items()}
    room[s], room[t] = {}, {}
    for i, x in lean.items():
        if x > 0:
            room[s][i], room[i][s] = x, 0.0
        elif x < 0:
            room[i][t], room[t][i] = -x, 0.0
    tiny = 1e-12
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return set(level) - {s}
        steps = {i: iter(list(room[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0.0) + push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= tiny)
                del path[cut + 1:]
                steps[path[-1]] = iter(list(room[path[-1]]))
                continue
            for j in steps[i]:
                if room[i][j] > tiny and level.get(j, -1) == level[i] + 1:
                    path.append(j)
                    break
            else:
                level[i] = -1
                path.pop()


def main_text(page: str | None) -> str:
    """The blocks labelled content, in page order, joined by newlines."""
    if not page:
        return ""
    blocks = page_blocks(page)
    soft = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    labels = cheapest_labels([soft(-s) for _, s, _, _ in blocks], [soft(s) for _, s, _, _ in blocks], _edges(blocks))
    return "\n".join(text for (text, *_), content in zip(blocks, labels) if content)


def extract(df: DataFrame, html: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all but the html by default), the main text and `n_chars`."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    names = [c for c in (keep or [c for c in df.columns if c != html]) if c.lower() not in (text.lower(), "n_chars")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), run(F.col(f"`{html}`").cast("string")).alias("main"))
    return rows.select(*unpacked(rows, names), F.col("main").alias(text), F.char_length("main").cast("long").alias("n_chars"))
