"""Operator 3: main text of web pages by two passes over their blocks.

First pass: each block is decided by a sum of evidence: its length and density of
stop words, its share of linked text, and whether an article element holds it (no
evidence on pages without one). A block with as much for as against stays ambiguous:
the short ones, and long ones without stop words, such as tables. Second pass: an
ambiguous block inherits the label of its nearest decided neighbour.
Menus, forms, comments, adverts and the like are left out by element and class before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import STOP_WORDS, slices, table

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Elements whose content is no markup, and where that content ends.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no article text.
DROPPED = set("nav footer aside form noscript template svg math canvas object applet audio video button select datalist menu dialog search head map".split())
#: Words of class, id and role that mark menus, adverts, notices, forms, comments and the like.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert alerts warning popup modal overlay toast newsletter subscribe subscription signup login paywall "
    "sidebar sidebars aside rail widget widgets menu menus nav navbar navigation navi topnav subnav breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations teaser teasers trending popular "
    "pagination pager paging skip search searchbox form copyright disclaimer legal contentinfo complementary tags tagcloud feedback".split()
)
#: The same, but only outside an article: there they may hold its heading.
OUTER_MARKS = {"header", "head", "heading"}
#: Words of class and id that mark the article itself.
INNER_MARKS = {"article", "articlebody", "post", "postbody", "entry", "story", "maincontent", "hentry"}
#: Elements that end when a sibling begins or a parent ends, even without an end tag.
LOOSE = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
STOP = {w for words in STOP_WORDS.values() for w in words}
EDGE = re.compile(r"^[\W_]+|[\W_]+$")

#: Words of a block that is decided by its own text; shares of stop words and of linked characters.
LONG, STOP_SHARE, LINK_SHARE = 15, 0.12, 0.5


@dataclass
class Block:
    text: str
    linked: int
    inside: bool
    heading: bool
    parent: int


def words_of(attributes: str) -> tuple[set[str], bool]:
    """The lower-case words of class, id, role and itemprop; whether the element is hidden."""
    found, hidden = set(), False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            spread = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", unescape(value))
            found |= {*re.split(r"[^a-z0-9]+", spread.lower()), *re.split(r"\s+", value.lower())}
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return found, hidden


def end_of_tag(html: str, at: int, hopeless: set[int]) -> int:
    """The place after the tag whose inside begins at a place; a > in quotes doesn't end it, unless the quotes have no end. -1 without an end.

    hopeless: places of quotes from which a scan has come to the end of the page without
    closing its tag. A scan that meets one ends, so all failing scans of a page together
    pass each of its quotes once.
    """
    place, met = at, []
    while m := QUOTE_OR_END.search(html, place):
        if m[0] == ">":
            return m.end()
        met.append(m.start())
        if m.start() in hopeless or (close := html.find(m[0], m.end())) < 0:
            break
        place = close + 1
    hopeless.update(met)
    return html.find(">", at) + 1 or -1


def tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether it is an end tag, name, attributes) of each tag, in one scan; at last the remaining text with an empty name.

    Comments and declarations are left out, as is what elements of RAW hold. A page is
    read once: what has no end is text, from there to the end of the page.
    """
    at, begin, last = 0, 0, html.rfind(">")
    hopeless: set[int] = set()
    while 0 <= (at := html.find("<", at)) < last:
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            yield html[begin:at], False, "", ""
            at = begin = close + 3 if close >= 0 else len(html)
        elif html.startswith(("<!", "<?"), at):
            yield html[begin:at], False, "", ""
            at = begin = html.find(">", at) + 1
        elif (m := NAME.match(html, at + 1)) and (close := end_of_tag(html, m.end(), hopeless)) > 0:
            name, ends = m[1].lower(), html[at + 1] == "/"
            yield html[begin:at], ends, name, html[m.end() : close - 1]
            at = begin = close
            if name in RAW and not ends:
                m = RAW[name].search(html, at)
                close = html.find(">", m.end()) if m else -1
                at = begin = close + 1 if close >= 0 else len(html)
        else:
            at += 1
    yield html[begin:], False, "", ""


def blocks(html: str) -> list[Block]:
    """The non-empty blocks of a page outside of dropped elements, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements: name, and "drop", "inside" or ""
    open_now: Counter[str] = Counter()
    dropping = inside = links = headings = 0
    parent, parents = 0, 0

    def flush() -> None:
        nonlocal parts, linked_parts
        if parts and (text := " ".join("".join(map(unescape, parts)).split())):
            out.append(Block(text, len(" ".join("".join(map(unescape, linked_parts)).split())), inside > 0, headings > 0, parent))
        parts, linked_parts = [], []

    def close(depth: int) -> None:
        nonlocal dropping, inside, links, headings, parent, parents
        while len(stack) > depth:
            name, kind = stack.pop()
            open_now[name] -= 1
            dropping -= kind == "drop"
            inside -= kind == "inside"
            links -= name == "a"
            headings -= name in HEADING
            if name in BLOCK and name not in LOOSE and name not in HEADING:
                parents += 1
                parent = parents

    for text, ends, name, attributes in tags(html):
        if text and not dropping:
            parts.append(text)
            if links:
                linked_parts.append(text)
        if not name or name in RAW:
            continue
        if name in BLOCK:
            flush()
        if ends:
            if open_now[name]:
                while stack[-1][0] != name:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, max(len(stack) - 7, -1), -1):
                if stack[k][0] == name and name in LOOSE or stack[k][0] == "p" and k == len(stack) - 1:
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] not in LOOSE:
                    break
        if name == "br" and not dropping:
            parts.append(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        kind = ""
        if name in DROPPED or name == "header" and not inside:
            kind = "drop"
        elif name in ("body", "html"):
            kind = ""
        else:
            marks, hidden = words_of(attributes) if attributes.strip() else ((), False)
            if hidden or marks and (MARKS & marks or not inside and OUTER_MARKS & marks and name in BLOCK):
                kind = "drop"
            elif name in ("article", "main") or marks and name in BLOCK and (INNER_MARKS & marks or "main" in marks and name in ("div", "section")):
                kind = "inside"
        stack.append((name, kind))
        open_now[name] += 1
        dropping += kind == "drop"
        inside += kind == "inside"
        links += name == "a"
        headings += name in HEADING
        if name in BLOCK and name not in LOOSE and name not in HEADING:
            parents += 1
            parent = parents
    flush()
    return out


def first_pass(found: list[Block]) -> list[bool | None]:
    """True: article; False: not; None: as much for as against.

    For: 1 for a long block with enough stop words, 2 for one in an article element.
    Against: 2 for mostly links, 3 if short too, 2 for a copyright line, 3 for one
    outside of the page's article elements. A short block is in an article element
    only by that, so its neighbours decide. On a page without any stop word in long
    blocks, whose language isn't among the lists, length alone counts as density.
    """
    framed = any(b.inside for b in found)
    words = [b.text.split() for b in found]
    shares = [sum(EDGE.sub("", w).lower() in STOP for w in own) / len(own) for own in words]
    known = not found or any(s > 0.02 for s, own in zip(shares, words, strict=True) if len(own) >= LONG)
    labels: list[bool | None] = []
    for b, own, share in zip(found, words, shares, strict=True):
        long, linked = len(own) >= LONG, b.linked > LINK_SHARE * len(b.text)
        evidence = (long and not linked and (share >= STOP_SHARE or not known)) - linked * (2 if long else 3) - 2 * b.text.startswith("©")
        if framed:
            evidence += 2 if b.inside else -3
        undecided = not evidence or b.inside and not long and evidence == 2
        labels.append(None if undecided else evidence > 0)
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block of the same frame.

    On equal distance a heading follows what comes after it, another block its own
    parent, else the article. Without a decided neighbour a block inside an article
    belongs to it; on a page without any decided text the parent with most words does.
    """
    before: list[int | None] = []
    after: list[int | None] = []
    for out, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[bool, int] = {}
        for k in order:
            out.append(last.get(found[k].inside))
            if labels[k] is not None:
                last[found[k].inside] = k
    after.reverse()
    sizes: Counter[int] = Counter()
    if True not in labels and not any(b.inside for b in found):
        for b, label in zip(found, labels, strict=True):
            if label is None:
                sizes[b.parent] += len(b.text.split())
    best = max(sizes, key=lambda p: (sizes[p], -p)) if sizes and max(sizes.values()) >= LONG else None
    out = []
    for k, b in enumerate(found):
        x, y = before[k], after[k]
        if labels[k] is not None:
            out.append(labels[k])
        elif best is not None:
            out.append(b.parent == best)
        elif x is None and y is None:
            out.append(b.inside)
        elif x is None or y is None:
            out.append(labels[y if x is None else x])
        elif labels[x] == labels[y]:
            out.append(labels[x])
        elif b.heading:
            out.append(labels[y])
        elif k - x != y - k:
            out.append(labels[x] if k - x < y - k else labels[y])
        elif (found[x].parent == b.parent) != (found[y].parent == b.parent):
            out.append(labels[x] if found[x].parent == b.parent else labels[y])
        else:
            out.append(True)
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    return " ".join(b.text for b, good in zip(found, second_pass(found, first_pass(found)), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", text: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, the main text and n_chars, its code points. One row per row,
    repeated rows included; null and empty pages have an empty text. Other columns aren't
    read. One pass without a shuffle."""
    source = pages.select(*keep, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(keep)):
                texts = [main_text(h) if h else "" for h in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, text, "n_chars"])

    return source.mapInArrow(run, ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + f", `{text}` string, n_chars bigint")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
