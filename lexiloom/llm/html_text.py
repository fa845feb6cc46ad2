"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags.  First pass: a block is
*good* or *bad* if structure or density decides it, else *short* or *near*
(ambiguous).  Structure: blocks inside navigation, forms, adverts, comments and
the like are bad.  All others go by density: many links, bad; enough text with
enough stop words, good.  Being inside an article is a prior: fewer stop words
are enough there, and too few make a block ambiguous instead of bad.  Second
pass: ambiguous blocks take the label of their nearest decided neighbours;
between a good and a bad one the nearer wins, at equal distance only those of
medium density or inside an article are kept.  Inside an article, what lies in
navigation and the like is no neighbour, and a block with nothing decided
before it is kept; outside, where an article has good text, only a heading
before good text or what has good text on both sides is kept.

Scale: pages are read once, without a shuffle, in time linear in their length.

Cases: a null page is empty; a page without good blocks gives an empty text.
Unclosed tags, comments and scripts end with the page; a cut-off tag at the end
is markup.  Nothing is capped.  Other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML element names by role.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, or isn't text to read.
RAW_TAGS = set("script style title textarea noscript noembed noframes iframe xmp template svg math object canvas audio video select".split())
BAD_TAGS = set("nav aside footer form button dialog menu search fieldset datalist".split())
GOOD_TAGS = set("article main".split())
#: Words of class, id and role names that mark what isn't article text.
BAD_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar sidenav side "
    "rail notice notices alert cookie cookies consent gdpr popup modal overlay dialog nav navbar navigation menu menubar topbar "
    "toolbar breadcrumb breadcrumbs pagination pager footer masthead header comment comments respond reply replies disqus share "
    "sharing social related recommended newsletter subscribe subscription signup login search searchbox form widget copyright "
    "legal disclaimer complementary contentinfo".split()
)
BAD_ARTICLE_NAMES = set("ad advert advertisement comment comments promo recommended related reply respond sponsored teaser".split())
OTHER_NAMES = set("has no with without".split())

# Frequent function words.
STOP_WORDS = {
    "en": set("a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you".split()),
    "fr": set("a au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split()),
    "de": set("aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht sich sie sind und von war wie wir zu zum zur".split()),
    "es": set("a al como con de del el en era es esta este ha hay la las le lo los mas me mi no nos o para pero por que se ser si sin sobre su sus un una y ya".split()),
}

SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
MAX_LINKS = 0.33

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_QUOTE_OR_END = re.compile("[\"'>]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=>/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT_NAME = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_LIST_ITEMS = {"li": "li", "p": "p", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}


@dataclass
class Block:
    text: str
    linked: int
    place: str  # good, bad or open
    heading: bool
    label: str = ""
    words: list[str] = field(default_factory=list)


def _bad_names(attrs: str, bad: set[str]) -> bool:
    """Whether a class, id or role says so; names like "with-sidebar" speak of something else."""
    for values in _NAMES.findall(attrs):
        for name in "".join(values).split():
            parts = {x.lower() for x in _SPLIT_NAME.split(name)}
            if parts & bad and not parts & OTHER_NAMES:
                return True
    return False


def _tag_end(page: str, at: int, last: dict[str, int], astray: set[int]) -> int:
    """Where the tag ends whose attributes begin at ``at``: after the first ">" outside quotes.

    A tag with a quote that nothing closes ends at its first ">".  ``last`` has the page's last place of
    each quote and of ">", and ``astray`` the quotes from which no end is found, so that no search runs twice.
    """
    begin, opened = at, []
    while at <= last[">"]:
        m = _QUOTE_OR_END.search(page, at)
        if m[0] == ">":
            return m.end()
        if m.start() >= last[m[0]] or m.start() in astray:
            break
        opened.append(m.start())
        at = page.index(m[0], m.end()) + 1
    astray.update(opened)
    return page.index(">", begin) + 1 if begin <= last[">"] else len(page)


def _role(name: str, attrs: str, inside: str) -> str:
    """good, bad or open: what an element makes of the text in it."""
    if name in ("html", "body"):
        return inside
    if inside == "bad" or name in BAD_TAGS or (name == "header" and inside != "good"):
        return "bad"
    if "=" in attrs or "hidden" in attrs:
        names = BAD_ARTICLE_NAMES if name in GOOD_TAGS else BAD_NAMES - {"header"} if inside == "good" else BAD_NAMES
        if _HIDDEN.search(attrs) or _bad_names(attrs, names):
            return "bad"
    return "good" if name in GOOD_TAGS else inside


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements: name, role of the text inside
    text: list[str] = []
    links = 0  # open links
    linked: list[str] = []

    def end_block() -> None:
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            role = stack[-1][1] if stack else "open"
            heading = any(re.fullmatch("h[1-6]", n) for n, _ in stack[-3:])
            found.append(Block(joined, len(" ".join("".join(linked).split())), role, heading))
        text, linked = [], []

    def add(piece: str) -> None:
        piece = html.unescape(piece)
        text.append(piece)
        if links:
            linked.append(piece)

    last, astray = {x: page.rfind(x) for x in "\"'>"}, set[int]()
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        at = _tag_end(page, m.end(), last, astray)
        attrs = page[m.end() : at]
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK_TAGS:
                end_block()
            if depth is not None:
                if any(n in BLOCK_TAGS for n, _ in stack[depth:]) and name not in BLOCK_TAGS:
                    continue  # a stray inline end tag closes no block
                del stack[depth:]
            continue
        if name in RAW_TAGS:
            if name not in ("noscript",) and attrs.endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK_TAGS:
            end_block()
            if stack and name in _LIST_ITEMS and stack[-1][0] == name:
                stack.pop()  # an unclosed item of the same kind ends here
            links = 0
        if name == "br":
            text.append(" ")
        if name in VOID_TAGS:
            continue
        if name == "a":
            links += 1
        if name != "a" or "=" in attrs:
            inside = stack[-1][1] if stack else "open"
            role = _role(name, attrs, inside) if name in BLOCK_TAGS or attrs not in (">", "/>") else inside
            if name in BLOCK_TAGS or role != inside:
                if role != inside and name not in BLOCK_TAGS:
                    end_block()
                stack.append((name, role))
    if at < len(page):
        add(page[at:])
    end_block()
    return found


def _stop_density(words: list[str]) -> float:
    return max(sum(w in stop for w in words) for stop in STOP_WORDS.values()) / len(words) if words else 0.0


def label(found: list[Block]) -> list[Block]:
    """Both passes; sets each block's label to good or bad."""
    for b in found:
        inside = b.place == "good"
        if b.place == "bad" or b.linked / len(b.text) > MAX_LINKS or (not inside and "\N{COPYRIGHT SIGN}" in b.text):
            b.label = "bad"
        elif len(b.text) < SHORT_CHARS:
            b.label = "bad" if b.linked and not inside else "short"
        else:
            density = _stop_density(re.findall(r"\w+", b.text.lower()))
            if density >= (STOP_LOW if inside else STOP_HIGH):
                b.label = "good" if len(b.text) > LONG_CHARS else "near"
            else:
                b.label = "near" if inside or density >= STOP_LOW else "bad"
    firm = [b.label for b in found]
    marked = any(b.place == b.label == "good" for b in found)
    around = list(zip(_nearest(firm), _nearest(firm[::-1])[::-1]))
    content = ["" if b.place == "bad" else b.label for b in found]
    around_content = list(zip(_nearest(content), _nearest(content[::-1])[::-1]))
    for i, b in enumerate(found):
        if firm[i] in ("good", "bad"):
            continue
        inside = b.place == "good"
        (left, far_left), (right, far_right) = (around_content if inside else around)[i]
        if left == right:
            b.label = left or ("good" if inside or firm[i] == "near" else "bad")
        elif b.heading and right == "good":
            b.label = "good"
        elif (inside and not left) or (marked and not inside):
            b.label = "good" if inside else "bad"
        elif far_left != far_right:
            b.label = (left if far_left < far_right else right) or left or right
        else:
            b.label = "good" if inside or firm[i] == "near" else "bad"
    return found


def _nearest(labels: list[str]) -> list[tuple[str, float]]:
    """For each place the last decided label before it, and how far back that is."""
    out, last, far = [], "", float("inf")
    for x in labels:
        far += 1
        out.append((last, far))
        if x in ("good", "bad"):
            last, far = x, 0
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in label(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by text and n_chars, its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            out = batch.drop_columns(["html"])
            yield out.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array(map(len, texts), pa.int64()))

    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*[f.name for f in kept], "html").mapInArrow(run, schema)
