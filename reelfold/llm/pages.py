"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text not interrupted by a block-level tag, each with the path of
elements from the root (tag names with classes). Text length and punctuation are added up for each path;
their ratios to the path's number of blocks are put back into page order, smoothed by a Gaussian and
multiplied. Paths whose value reaches a share of the values' standard deviation hold content. Content
blocks point to the element that holds the article, and everything in it is kept but for what markup
itself declares to be something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments).

Pages are independent, so this is one pass without a shuffle. Rows: a null page counts as empty and has
an empty text; very long pages are read whole in linear time; broken markup (tags left open, stray ends)
is repaired the way browsers do for paragraphs and list items; repeated rows are repeated; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from reelfold.llm.tables import in_batches

THRESHOLD = 0.3  # of the standard deviation of the fused ratios
SMOOTHING = 1.0  # standard deviation of the Gaussian, in blocks
_RADIUS = 2

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|svg|math|title)\b"
    r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attr>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attr2>[^<>]*+)>"
    r"|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？…]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
_NOT_TEXT = frozenset(
    "head nav footer aside form fieldset button select option dialog menu object applet audio video canvas "
    "datalist".split()
)
#: Words of class, id and role that name something other than the article.
_NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar sidebar aside rail widget widgets complementary contentinfo "
    "comment comments commentlist disqus respond replies discussion "
    "notice notices cookie cookies consent gdpr alert popup modal overlay dialog paywall "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login form search copyright legal tags skip".split()
)
# a start tag of the left closes open elements of the right, up to the nearest container
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body".split())
_KEEPS_PARAGRAPH = _INLINE | {"label", "input"}


@dataclass(slots=True)
class _Element:
    tag: str
    key: str
    number: int
    skipped: bool  # it or an ancestor holds no article text
    article: bool  # it or an ancestor is declared the article


@dataclass(slots=True)
class Block:
    text: str
    path: str
    elements: tuple[int, ...]


def _named(attributes: str) -> set[str]:
    found: set[str] = set()
    for groups in _NAMES.findall(attributes):
        for word in _WORDS.findall("".join(groups)):
            found.add(word.lower())
    return found


def read_blocks(page: str) -> tuple[list[Block], dict[int, str]]:
    """Text blocks in page order and the tag of every element number."""
    root = _Element("", "", 0, False, False)
    stack, tags = [root], {0: ""}
    blocks: list[Block] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            top = stack[-1]
            if not top.skipped:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    blocks.append(
                        Block(text, top.key, tuple(e.number for e in stack))
                    )
            run.clear()

    def close(down_to: int) -> None:
        if any(e.tag not in _INLINE for e in stack[down_to:]):
            flush()
        del stack[down_to:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            else:
                if tag not in _INLINE:
                    flush()
            continue
        if tag in ("br", "wbr", "hr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag in _VOID:
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
            if tag not in _KEEPS_PARAGRAPH:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag not in _INLINE:
                        break
            closes = _CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        del stack[i:]
                        break
                    if stack[i].tag in _SCOPES:
                        break
        attributes = m["attr"] or m["attr2"] or ""
        top = stack[-1]
        names = _named(attributes) if "=" in attributes else ()
        article = top.article or tag in ("article", "main")
        skipped = (
            top.skipped or tag in _NOT_TEXT
            or tag == "header" and not top.article
            or tag not in ("html", "body", "article", "main") and not _NOT_ARTICLE.isdisjoint(names)
            or bool(attributes) and _HIDDEN.search(attributes) is not None
        )
        if inline and skipped != top.skipped:
            flush()
        if attributes.endswith("/") and inline:
            continue
        key = top.key if inline else f"{top.key}/{tag}" + (f".{'.'.join(sorted(names))}" if names else "")
        number = len(tags)
        tags[number] = tag
        stack.append(_Element(tag, key, number, skipped, article))
    if at < len(page):
        run.append(page[at:])
    flush()
    return blocks, tags


def _smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-((d / SMOOTHING) ** 2) / 2) for d in range(-_RADIUS, _RADIUS + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(-_RADIUS, _RADIUS + 1), weights):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def content_paths(blocks: list[Block], threshold: float = THRESHOLD) -> set[str]:
    """Paths whose smoothed text and punctuation ratios together reach the threshold."""
    sums: dict[str, list[int]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
    lengths = _smoothed([sums[b.path][1] / sums[b.path][0] for b in blocks])
    points = _smoothed([(sums[b.path][2] + 1) / sums[b.path][0] for b in blocks])
    fused = [a * b for a, b in zip(lengths, points)]
    best: dict[str, float] = {}
    for b, value in zip(blocks, fused):
        best[b.path] = max(best.get(b.path, 0.0), value)
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused))
    least = min(threshold * deviation, max(fused))
    # the path with most text is content however even the page is
    most = max(sums, key=lambda p: sums[p][1])
    return {p for p, v in best.items() if v >= max(least, mean)} | {most}


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line."""
    if not page:
        return ""
    blocks, tags = read_blocks(page)
    if not blocks:
        return ""
    paths = content_paths(blocks)
    chosen = [b for b in blocks if b.path in paths]
    total = sum(len(b.text) for b in chosen)
    held: dict[int, int] = {}
    for b in chosen:
        for e in b.elements:
            held[e] = held.get(e, 0) + len(b.text)
    declared = [e for e, n in held.items() if tags[e] in ("article", "main") and 2 * n > total]
    if declared:
        home = max(declared, key=lambda e: (tags[e] == "article", -e))  # outermost article, else main
    else:
        home = max(e for e, n in held.items() if n == total)  # elements are numbered top down
        while tags[home] in _INLINE or tags[home] in ("p", "li", "td", "h1", "h2", "h3"):
            place = chosen[0].elements.index(home)
            if place == 0:
                break
            home = chosen[0].elements[place - 1]
    return "\n\n".join(b.text for b in blocks if home in b.elements)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType([
        T.StructField("page_id", pages.schema[id_col].dataType),
        T.StructField("url", pages.schema[url_col].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])
    return pages.select(id_col, url_col, html_col).transform(in_batches, read, schema)
