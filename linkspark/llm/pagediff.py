"""Main text of web pages by markup zones and nearest-URL page differencing.

A page is cut into blocks of text. Blocks in elements that are no content by their
name, role or class (menus, forms, adverts, comments...) go. Pages of a host are
ordered by URL path, each is aligned with its nearest neighbour by the longest common
subsequence of their lines, and lines that both share are deleted: what a site repeats
from page to page. Lines inside an element that the page itself marks as its article
are not deleted, as neighbours may carry the same article; nor are lines shared with a
neighbour that is a copy of the page as a whole: behind a run of copies the page before
the run is the neighbour, and of pages at the start of a host the first one that is no copy.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.cascade import host_and_path
from linkspark.llm.common import mapped
from linkspark.llm.order import dealt

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea|select|object|canvas|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no content; the last three may head, foot or flank an article's own parts.
NO_CONTENT = frozenset("head nav form button dialog menu footer header aside".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id: no content anywhere, and no content outside an article.
NOT_IN_ARTICLES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription comment comments commentlist respond disqus replies reply sidebar menu nav navbar navigation breadcrumb breadcrumbs".split())
NOT_OUTSIDE = frozenset("header footer masthead topbar banner widget widgets share sharing social related recommended login search pagination pager toolbar".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: A neighbour is a copy of the page if more than this share of the larger one's content characters is common to both.
COPY = 0.9


class Block(NamedTuple):
    text: str
    content: bool  # not in an element that is no content
    article: bool


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(no content, the article)."""
    out = tag in NO_CONTENT and not (in_article and tag == "header")
    main = tag in ("article", "main")
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                out |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                out = True
            elif name in ("class", "id") and tag not in ("html", "body"):
                words = {w.lower() for w in NAME_WORD.findall(value)}
                out |= bool(words & NOT_IN_ARTICLES) or not in_article and not main and bool(words & NOT_OUTSIDE)
    return out, main


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, white space squeezed, character references decoded."""
    found: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: dict[str, int] = {}  # how often a tag is on the stack
    dropped = inside = at = 0

    def close() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                found.append(Block(text, not dropped, bool(inside)))
            held.clear()

    for m in PIECE.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                close()
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if not m[2]:
            if m[4].endswith("/") and tag not in INLINE and tag not in ("p", "div"):
                continue
            out, main = _marks(tag, m[4], inside > 0)
            if out:
                close()
            stack.append((tag, out, main))
            opened[tag] = opened.get(tag, 0) + 1
            dropped += out
            inside += main
        elif opened.get(tag):
            if dropped:
                close()
            while stack:
                name, out, main = stack.pop()
                opened[name] -= 1
                dropped -= out
                inside -= main
                if name == tag:
                    break
    if at < len(page):
        held.append(page[at:])
    close()
    return found


def common(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """The places in a of a longest common subsequence of the lines of a and b."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            ends[k : k + 1] = [j]
            links[k : k + 1] = [link]
    out = []
    link = links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return [*range(head), *out[::-1], *range(len(a) - tail, len(a))]


def shared_lines(page: list[Block], other: list[Block]) -> set[int] | None:
    """The places of page's lines that an alignment with other shares; None if other is a copy of the page."""
    found = common([b.text for b in page], [b.text for b in other])
    size = max(sum(len(b.text) for b in x if b.content) for x in (page, other))
    if sum(len(page[k].text) for k in found if page[k].content) > COPY * size:
        return None
    return set(found)


def difference(page: list[Block], neighbours: list[list[Block]]) -> tuple[list[str], int]:
    """(the lines that stay, the number of shared lines). neighbours: the nearest first; the first that is no copy counts."""
    shared = next((x for x in (shared_lines(page, other) for other in neighbours) if x is not None), set())
    return [b.text for k, b in enumerate(page) if b.content and (b.article or k not in shared)], len(shared)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Page(NamedTuple):
    place: int
    extra: int
    page: int | None
    url: str | None
    host: str
    path: str
    blocks: list[Block]


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_range: int = 1000) -> DataFrame:
    """Per row: id, url, text (blocks joined by a newline), n_chars (code points), n_shared (lines it has in common with its neighbour).

    Null html gives an empty text; so does a page without content. Pages without a host
    have no neighbours. Of equal urls the smaller id comes first. Rows that repeat stay.
    An empty table gives an empty one. Other columns are not looked at. Pages are read
    whole, elements nested to any depth. A range's pages all copies of each other and of
    those at its ends keep their shared lines outside articles, as no other page is in sight.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id_"), F.col(url_col).alias("url_"), F.coalesce(F.col(html_col), F.lit("")).alias("html_"))
    host, path = host_and_path(F.col("url_"))
    rows = rows.withColumns({"host_": host, "path_": path})
    # the id makes keys of equal urls differ, so that ranges may be cut among them
    ident = F.lpad(F.hex(F.bitwise_not(F.coalesce("id_", F.lit((1 << 63) - 1))).bitwiseXOR(F.lit((1 << 63) - 1))), 16, "0")
    key = F.encode(F.concat("host_", F.lit("\0"), "path_", F.lit("\0"), F.coalesce("url_", F.lit("")), F.lit("\0"), ident), "utf-8")
    ordered = dealt(rows, key, rows_per_range, before=True).sortWithinPartitions("range_", "extra_", "key_", "html_")
    names = [id_col, "url", "text", "n_chars", "n_shared"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        earlier: _Page | None = None  # the nearest page before that is no copy of the one at hand
        here: _Page | None = None
        waiting: list[_Page] = []  # copies of each other at the start of a host: the first page that is no copy is their neighbour

        def told(page: _Page, near: list[_Page]) -> None:
            if not page.extra:
                near = sorted(near, key=lambda x: -_prefix(x.path, page.path))
                lines, shared = difference(page.blocks, [x.blocks for x in near])
                text = "\n".join(lines)
                out.append((page.page, page.url, text, len(text), shared))

        def seen(now: _Page | None) -> None:
            nonlocal earlier, here
            if now and (not here or now.place != here.place or now.host != here.host or not now.host):
                seen(None)
            elif now and here:
                copy = shared_lines(here.blocks, now.blocks) is None
                if copy and now.blocks == here.blocks:
                    now = now._replace(blocks=here.blocks)  # one object for all equal ones
                if not copy:
                    for page in waiting:
                        told(page, [now])
                    waiting.clear()
                    told(here, [x for x in (earlier, now) if x])
                    earlier = here
                elif earlier:
                    told(here, [earlier])
                else:
                    waiting.append(here)
            elif here:
                for page in waiting:
                    told(page, [])
                waiting.clear()
                told(here, [earlier] if earlier else [])
                earlier = None
            here = now

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):
                place, extra, page, url, host, path, source = (batch.column(c)[k].as_py() for c in range(7))
                seen(_Page(place, extra, page, url, host, path, blocks(source)))
                if len(out) >= 200:
                    yield batch_of()
        seen(None)
        if out:
            yield batch_of()

    schema = f"`{id_col}` bigint, url string, text string, n_chars bigint, n_shared bigint"
    return mapped(ordered.select("range_", "extra_", "id_", "url_", "host_", "path_", "html_"), run, schema)
