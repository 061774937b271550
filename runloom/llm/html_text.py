"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks in navigation, footers, asides, forms (but for one that holds most of the text), hidden elements and containers whose
class or id names boilerplate (as a whole or by its end, as in site-footer, not as in with-sidebar or entry-header) are bad;
but a name around the page's only article or main element, or on its only long text with many stop words, is passed over. Pass 1 decides every other block from the share of stop words, its length and its link
density: bad with many links, good when long with many stop words, bad when long with few, and otherwise ambiguous. The
article (or else main) element is a vote beside that: inside it, few stop words make a block ambiguous only; outside it,
only long text with many stop words is good at once. Text in a script of which no stop words are known is decided by its length and the ends of its sentences. The vote is void where such text outside outweighs the text inside.
Pass 2 gives ambiguous blocks the label of the nearest decided neighbours: good where both sides are good, or the nearer one
is; where the sides differ, the vote decides; headings look to the block after them. Inside the article only its own blocks
are neighbours, and it is good where none is decided.

Defined results: null, empty and text-free pages give empty text; unclosed tags, stray "<" and quotes, unknown references and
unclosed comments or scripts don't fail, nor do they take more than linear time (an unclosed comment or script hides the rest; a head ends where something stands that it can't hold); rows with null ids or urls
and repeated rows are carried; other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready

MAX_LINKS, SHORT, LONG = 0.5, 60, 160
MANY_STOP, SOME_STOP = 0.3, 0.15

# HTML element classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav aside footer head menu dialog".split())
FORM_TAGS = frozenset("form fieldset".split())
HEAD_TAGS = frozenset("head title meta link base style script noscript template".split())  # what a head may hold
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus foot footer footnav head header masthead menu modal nav navbar navigation newsletter notice notices overlay popup "
    "promo promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
# Parts of a name that turn its meaning, that make a header the text's own, and that say nothing after another part.
NO_PARTS = frozenset("no not non with without has hide".split())
OWN_PARTS, OWN_HEADERS = frozenset("entry article post".split()), frozenset("head header banner masthead".split())
PLACE_PARTS = frozenset("list area box slot block section left right top bottom thread threads".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
STOP_WORDS = frozenset(
    "the of and to a in that is was it for on with as be by this are from or at an not but have which they you his her we "
    "de la le les et des en un une du que qui dans pour est pas par sur au avec ce il elle plus "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "el los las y se del al lo con una por para no su como más pero sus".split()
)

# Attributes up to ">": anything but "<" and ">", which may stand in a quoted value only. No part can match in two ways and nothing is given
# back, so a page is read in linear time however it is broken.
_ATTRS = r"(?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|button|object)(?=[\s/>])" + _ATTRS + r">.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>" + _ATTRS + r")(?P<whole>>?)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_STYLE = re.compile(r"(?:^|\s)style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_OTHER = re.compile(r"[^\x00-\u024f\W]")  # letters of scripts that are not Latin
_END = re.compile(r"[.!?。！？؟।…](?:\s|$|[\"'”»）)])|[。！？]")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    named: int  # a class or id names boilerplate: 0 none, 1 only around the article or main element, 2 within or without one
    article: bool
    main: bool
    heading: bool
    form: bool


def bad_name(name: str) -> bool:
    """Whether a class or id names boilerplate, as a whole or by its end."""
    if name in BAD_NAMES:
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x]
    while len(parts) > 1 and (parts[-1] in PLACE_PARTS or parts[-1].isdigit()):
        parts.pop()
    if not parts or parts[-1] not in BAD_NAMES or NO_PARTS.intersection(parts):
        return False
    return not (parts[-1] in OWN_HEADERS and OWN_PARTS.intersection(parts))


def names_boilerplate(attrs: str) -> tuple[bool, bool]:
    """Whether an element is hidden or has a role of boilerplate, and whether a class or id names it so."""
    if not attrs or not attrs.strip():
        return False, False
    style = _STYLE.search(attrs)
    hard = bool(_HIDDEN.search(_VALUE.sub("=", attrs)) or style and _UNSEEN.search("".join(filter(None, style.groups()))))
    soft = False
    for kind, *values in _NAMED.findall(attrs):
        for name in "".join(values).lower().split():
            if kind.lower() == "role":
                hard = hard or name in BAD_ROLES
            else:
                soft = soft or bad_name(name)
    return hard, soft


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, white space in each as one space."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements, and whether they are boilerplate, by themselves and by name
    depth: dict[str, int] = {}
    bad = named = 0
    around = 0  # boilerplate names around the outermost article or main element

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                holds = depth.get("article") or depth.get("main")
                names = 0 if not named else 1 if holds and named == around else 2
                heading = any(depth.get(f"h{i}") for i in range(1, 7))
                out.append(Block(whole, linked, bad > 0, names, bool(depth.get("article")), bool(depth.get("main")), heading, bool(depth.get("form") or depth.get("fieldset"))))
            text.clear()
        linked = 0

    def add(x: str) -> None:
        nonlocal linked
        text.append(x)
        if depth.get("a"):
            linked += len(x)

    def close(tag: str) -> None:
        nonlocal bad, named
        while stack:
            name, was_bad, was_named = stack.pop()
            depth[name] -= 1
            bad -= was_bad
            named -= was_named
            if name == tag:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if not m["whole"]:  # no tag: text with a stray "<"
            add(m[0])
            continue
        if m["end"]:
            if tag in BLOCK_TAGS:
                end_block()
            if depth.get(tag):
                close(tag)
            continue
        if tag == "br":
            text.append(" ")
        if depth.get("head") and tag not in HEAD_TAGS:  # its end tag may be left out
            end_block()
            close("head")
        if tag in BLOCK_TAGS:
            end_block()
            if depth.get("p") and stack and tag != "hr":
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(tag)
        if tag in VOID_TAGS or (m["attrs"] or "").endswith("/") and tag not in BLOCK_TAGS:
            continue
        attrs = m["attrs"] or ""
        inner = bool(depth.get("article"))
        mine = tag in BAD_TAGS or tag == "header" and not inner
        hard, soft = names_boilerplate(attrs) if tag not in ("body", "html", "article", "main") else (False, False)
        if tag in ("article", "main") and not depth.get("article") and not depth.get("main"):
            around = named
        mine = mine or hard
        stack.append((tag, mine, soft))
        depth[tag] = depth.get(tag, 0) + 1
        bad += mine
        named += soft
    if at < len(page):
        add(page[at:])
    end_block()
    return out


def votes(found: list[Block], bad: list[bool], rules: list[bool | None]) -> list[int]:
    """What the markup says of each block: 1 inside the article (or else main) element, -1 outside, 0 nothing."""
    fine = [b for b, x in zip(found, bad) if not x]
    article = any(b.article for b in fine)
    if not article and not any(b.main for b in fine):
        return [0] * len(found)
    vote = [1 if b.article or not article and b.main else 0 if b.main else -1 for b in found]
    inside = sum(len(b.text) for b, x, v in zip(found, bad, vote) if not x and v > 0 and b.linked <= MAX_LINKS * len(b.text))
    outside = sum(len(b.text) for b, x, v, r in zip(found, bad, vote, rules) if not x and v < 1 and r and len(b.text) > LONG)
    return [0] * len(found) if outside > inside else vote


def by_rules(b: Block) -> bool | None:
    """Pass 1 for a block by itself, whatever the markup says."""
    n = len(b.text)
    foreign = 0 if b.text.isascii() else len(_OTHER.findall(b.text))
    if 2 * foreign > n and b.linked <= MAX_LINKS * n:  # a script of which no stop words are known: by length and ends of sentences
        size = n * (2 if sum("\u2e80" <= c <= "\uffdc" for c in b.text) * 2 > n else 1)
        ends = len(_END.findall(b.text))
        return None if size < SHORT else True if ends and (size > LONG or ends > 1) else None if ends or size <= LONG else False
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))
    if b.linked > MAX_LINKS * n:
        return None if b.heading else False
    if n < SHORT:
        return None
    if stop >= MANY_STOP or n > LONG and stop >= SOME_STOP:
        return True
    return None if stop >= SOME_STOP else False


def nearest(label: list[bool | None]) -> list[tuple[bool | None, int]]:
    """The last decided label up to each block, and how far back it is."""
    out: list[tuple[bool | None, int]] = []
    last, gap = None, 1 << 60
    for x in label:
        last, gap = (x, 0) if x is not None else (last, gap + 1)
        out.append((last, gap))
    return out


def classify(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    rules = [by_rules(b) for b in found]
    # forms are boilerplate, but for one that holds most of the text, as a page that is one form does
    told = [b for b in found if not b.bad and b.linked <= MAX_LINKS * len(b.text)]
    inside = sum(len(b.text) for b in told if b.form)
    if 2 * inside <= sum(len(b.text) for b in told):
        for b in found:
            b.bad = b.bad or b.form
    # a name around the only article or main element doesn't make it bad
    own = any((b.article or b.main) and not b.bad and not b.named for b in found)
    bad = [b.bad or b.named > (0 if own else 1) for b in found]
    out = decide(found, bad, rules)
    if not any(out) and any(b.named for b in found):  # nor does it void the only long text with many stop words
        out = decide(found, [b.bad or bool(b.named) and not (r and len(b.text) > LONG) for b, r in zip(found, rules)], rules)
    return out


def decide(found: list[Block], bad: list[bool], rules: list[bool | None]) -> list[bool]:
    """Both passes, given which blocks the markup makes bad."""
    vote = votes(found, bad, rules)
    label: list[bool | None] = []
    for b, x, v, r in zip(found, bad, vote, rules):  # pass 1
        linked = b.linked > MAX_LINKS * len(b.text)
        if x:
            label.append(False)
        elif v > 0:
            label.append(None if r is False and not linked else r)
        else:
            label.append(None if v < 0 and r and len(b.text) <= LONG else r)
    out = [bool(x) for x in label]
    for inner in (True, False):  # pass 2
        among = [i for i in range(len(found)) if (vote[i] > 0 and not bad[i]) or not inner]
        here = [label[i] for i in among]
        ends = zip(among, nearest(here), reversed(nearest(here[::-1])))
        for i, (left, far), (right, gap) in ends:
            if label[i] is not None or (vote[i] > 0) != inner:
                continue
            if inner and left is None and right is None:
                out[i] = True
            elif found[i].heading:
                out[i] = inner if right is None else right
            elif inner:
                out[i] = left is not False or right is not False
            elif vote[i] < 0:
                out[i] = bool(left and right)
            else:  # past the ends of the page nothing is good
                out[i] = bool(left if left == right or gap >= far else right)
        label = [x if x is not None or (v > 0) != inner else y for x, y, v in zip(label, out, vote)]
    return out


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns in keep, text, n_chars (code points)."""
    ready(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    fields = [f for f in rows.schema.fields if f.name != "__html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = [main_text(x) for x in part.column("__html").to_pylist()]
                cols = [*(part.column(f.name) for f in fields), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in fields), "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
