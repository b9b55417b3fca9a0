"""Main text of web pages by two passes of block rules.

A scanner cuts the page into blocks at block-level tags and notes, for each, its text, its share of link text, whether
it is a heading, and where it stands: under an element that is never main text (menus, footers, forms, scripts, adverts,
notices, comments ...), which is left out, or under ``article``/``main``.

* Pass 1 decides by stop-word density, length and link density: long blocks of connected text are main text, blocks of
  links or of a rights notice are not, all others stay undecided. ``article``/``main`` is a feature beside these: where
  the blocks under it hold most of the page's text that is no link, they need less to be decided as main text, and blocks
  outside are not main text. A page that marks a small part of its text so is read as if it had no such mark.
* Pass 2 gives each undecided block the label of the nearest decided neighbour. If both are as near and differ, main text
  wins for a middling block and the other label for a short one; a middling block without links is left out only between
  two blocks that are. A heading takes the label of what follows it. A page without a decided block is main text.

Defined cases: null or empty html gives an empty text; broken markup never fails (unclosed elements end with the page,
stray end tags are passed over, an unclosed comment or script takes the rest of the page); elements may be nested to any
depth and pages of any length are read whole; repeated rows and pages give a row each; null ids and urls are returned as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import slices, small_batches

TAG = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")

# fixed values: the elements of HTML by kind
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("script style noscript template iframe object svg canvas math audio video map nav footer aside form button select textarea input dialog menu head title search noembed noframes".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article main body nav aside header footer form".split())
# fixed values: words of class, id and role that mark what is not main text
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary contentinfo footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus respond reply replies "
    "pagination pager widget widgets search searchbox tags tagcloud copyright disclaimer alert skip hidden paywall".split()
)
CONTAINERS_AWAY = frozenset("header".split())
# fixed values: the most common words of some languages
STOP = frozenset(
    "the of and to in a is that it for on was with as be by at are this from or an which you not have but they his her were their "
    "der die und das ist nicht ein eine zu den von mit sich des auf für im dem auch es an er hat als bei aus nach wie "
    "le la les de des du et en un une est que qui dans pour pas sur au par ce il sont avec plus ne se ou son "
    "el los las y que del se por con una para es al lo como más o pero sus le ha su no si "
    "di che il e per non sono della con una del da nel si al het een van dat op te zijn voor met niet o os do da em um uma não".split()
)

# fixed values: words of rights notices
RIGHTS = re.compile(r"©|\(c\)\s|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos", re.I)
#: Pass 1: links share (and that of a block under a trusted mark), lengths in characters, stop-word densities.
LINKS, LINKS_MARKED, SHORT, LONG, FEW, MANY = 0.3, 0.9, 70, 200, 0.12, 0.25
GOOD, BAD, MIDDLING, BRIEF = "good", "bad", "middling", "brief"


class Block:
    __slots__ = ("main", "heading", "pieces", "linked", "list_item", "text")

    def __init__(self, main: bool, heading: bool, list_item: bool):
        self.main, self.heading, self.list_item, self.pieces, self.linked, self.text = main, heading, list_item, [], 0, ""


def _away(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in NEVER:
        return True
    if tag == "header":
        return not in_main
    if not attributes or tag in ("html", "body"):
        return False
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words.update(x.lower() for x in NAME.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    if tag == "main":
        return False
    return bool(words & AWAY) or tag not in HEADINGS and tag not in ("p", "article") and not in_main and bool(words & CONTAINERS_AWAY)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag, away, main, link, list item, heading
    open_: Counter[str] = Counter()  # how many elements of a tag are open
    now = None
    at, n = 0, len(page)

    def state():
        return stack[-1] if stack else ("", False, False, False, False, False)

    def add(raw: str):
        nonlocal now
        _, away, main, link, item, heading = state()
        if away:
            return
        if now is None:
            now = Block(main, heading, item)
            out.append(now)
        text = html.unescape(raw) if "&" in raw else raw
        now.pieces.append(text)
        if link:
            now.linked += len(text.strip())

    def close(to: int):
        nonlocal now
        while len(stack) > to:
            tag, away, *_ = stack.pop()
            open_[tag] -= 1
            if away or tag in BLOCKS:
                now = None

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2)
            at = n if end < 0 else max(end + 3, at)
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            if tag in BLOCKS:
                now = None
            continue
        attributes = m[3] or m[6] or ""
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            now = None
            for k in range(len(stack) - 1, -1, -1) if open_["p"] else ():  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1) if any(open_[x] for x in CLOSED_BY[tag]) else ():
                if stack[k][0] in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPES and not (tag in ("td", "th") and stack[k][0] == "div"):
                    break
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        _, away, main, link, item, heading = state()
        away_now = away or _away(tag, attributes, main)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        heading = tag in HEADINGS or heading and tag not in BLOCKS
        stack.append((tag, away_now, main or tag in MAIN, link or tag == "a", tag == "li" or item and tag not in SCOPES, heading))
        open_[tag] += 1
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in out if b.text]


def density(text: str) -> float:
    """The share of stop words among the words, signs around and inside words aside."""
    words = WORD.findall(text.lower())
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block]) -> list[str]:
    plain = [len(b.text) - b.linked for b in found]
    inside = sum(n for b, n in zip(found, plain, strict=True) if b.main)
    trusted = inside > sum(plain) - inside
    labels = []
    for b in found:
        marked = trusted and b.main
        links = b.linked / len(b.text)
        if links > (LINKS_MARKED if marked and not b.list_item else LINKS) or trusted and not marked:
            labels.append(BAD)
        elif len(b.text) < SHORT:
            labels.append(BAD if RIGHTS.search(b.text) and not marked else BRIEF)
        elif density(b.text) >= (FEW if marked else MANY) and len(b.text) >= (SHORT if marked else LONG):
            labels.append(GOOD)
        else:
            labels.append(BAD if len(b.text) < LONG and RIGHTS.search(b.text) and not marked else MIDDLING)
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    n = len(labels)
    before, after = [-1] * n, [-1] * n  # the nearest decided blocks
    last = -1
    for i in range(n):
        before[i] = last
        last = i if labels[i] in (GOOD, BAD) else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in (GOOD, BAD) else last
    out = []
    for i, label in enumerate(labels):
        b, a = before[i], after[i]
        if label in (GOOD, BAD):
            out.append(label == GOOD)
        elif label == MIDDLING and not found[i].linked:
            out.append(not (b >= 0 and a >= 0 and labels[a] == labels[b] == BAD))
        elif b < 0 and a < 0:
            out.append(True)
        elif b < 0 or a >= 0 and (found[i].heading or labels[a] == labels[b] or a - i < i - b):
            out.append(labels[a] == GOOD)
        elif a < 0 or i - b < a - i:
            out.append(labels[b] == GOOD)
        else:
            out.append(label == MIDDLING)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, second_pass(found, first_pass(found)), strict=True) if keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
