"""Main text of web pages by nearest-URL page differencing (operator 10).

A page is read into text lines, one for each block, each with the kind of element it stands in.  Pages of a host stand in
the order of their paths; each is paired with that neighbour whose path shares more leading characters with its own (the
earlier one where both share as many), and the two pages' lines are aligned by their longest common subsequence.  Lines
that both have are the site's: differencing proposes to delete them.

Differencing alone cannot give right results where a site writes each page's menu or advert anew, or where two pages of a
site carry the same paragraph.  So elements speak too: lines in an article (or, without one, in main) are kept though they
are shared, and lines in elements that hold no main text (menus, footers, forms and the like) go in any case, as do all
lines outside the article of a page that has one.  Each page's row counts the lines that went for being shared, those that
went by their elements alone, and those that elements kept.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.common import map_rows, prepare, ranges

#: Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; the first two last to the page's end where they are left open.
RAW = frozenset("script style textarea title template iframe noembed noframes svg".split())
TO_THE_END = frozenset(("script", "style"))
#: Elements, classes and roles whose text is not main text.
OFF_TAGS = frozenset("nav footer aside form menu dialog button select head search".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar comment comments respond disqus newsletter subscribe signup share sharing social related recommended "
    "pagination pager".split()
)
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "option", "optgroup"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[A-Za-z][^<>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")

ARTICLE, MAIN, LOOSE, OFF, SHUT = "A", "M", "L", "X", "Y"  # SHUT: OFF whatever is inside, articles too
SHUT_TAGS = frozenset(("aside", "form"))
SHUT_WORDS = frozenset(("comment", "comments", "respond", "disqus"))


def _off(tag: str, attributes: str, in_article: bool) -> str | None:
    """OFF or SHUT for an element that holds no main text."""
    if tag in SHUT_TAGS:
        return SHUT
    off = OFF if tag in OFF_TAGS or tag == "header" and not in_article else None
    if not attributes or tag in ("html", "body", "main"):
        return off
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in OFF_ROLES:
            off = OFF
        elif name in ("class", "id"):
            words = SPLIT.split(value)
            if not SHUT_WORDS.isdisjoint(words):
                return SHUT
            if not OFF_WORDS.isdisjoint(words):
                off = OFF
    return off


def lines_of(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every block that has text, in page order.

    kind: ARTICLE, MAIN, LOOSE (elsewhere) or OFF (in an element that holds no main text).  Character references are decoded
    and white space within a block is one space.  Elements may be left open: an end tag closes what is open within its
    element, a new block closes an open paragraph, an article closes what is off above it unless that is an aside, a form
    or comments.
    """
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, kind of its text
    parts: list[str] = []
    kind, at = LOOSE, 0
    opened: Counter = Counter()  # the tags on the stack
    unclosed: set[str] = set()  # raw elements of which no end is left in the page

    def leave():
        tag, _ = stack.pop()
        opened[tag] -= 1
        return tag

    def end_block():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((OFF if kind == SHUT else kind, text))
            parts.clear()

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                if tag in BLOCKS:
                    end_block()
                while leave() != tag:
                    pass
                around = stack[-1][1] if stack else LOOSE
                if around != kind:  # an inline element that was off: its text is no part of the block around it
                    end_block()
                kind = around
            elif tag in BLOCKS:
                end_block()
            continue
        if tag in RAW:
            closing = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if closing:
                at = page.find(">", closing.start()) + 1 or len(page)
            else:
                unclosed.add(tag)
                at = len(page) if tag in TO_THE_END else at
            parts.append(" ")
            continue
        if tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in BLOCKS:
            end_block()
            if tag in PARAGRAPH_ENDS and any(t == "p" for t, _ in stack[-8:]):
                while leave() != "p":
                    pass
                kind = stack[-1][1] if stack else LOOSE
            if tag in ("article", "main"):
                while kind == OFF:
                    leave()
                    kind = stack[-1][1] if stack else LOOSE
        if tag in VOID:
            continue
        attributes = m.group(3)
        below = kind
        if kind not in (OFF, SHUT):
            if tag == "article":
                below = ARTICLE
            elif tag == "main" and kind == LOOSE:
                below = MAIN
            below = _off(tag, attributes, below in (ARTICLE, MAIN)) or below
        stack.append((tag, below))
        opened[tag] += 1
        if tag in BLOCKS or below == kind:
            kind = below
        else:  # an inline element that is off: its text is a block of its own
            end_block()
            kind = below
        if attributes.endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            leave()
            kind = stack[-1][1] if stack else LOOSE
    end_block()
    return out


#: Bytes of bit vectors that an alignment may hold; longer ones are made in halves.
HELD = 32 << 20


def _rows(own: list[str], other: list[str], keep: bool) -> list[int]:
    """A bit vector for each line of own, or the last one only: bit j is 0 where the longest common subsequence of the lines
    so far grows with the j-th line of other.  Lines of other are bits of one integer, so a line costs one sum."""
    at: dict[str, int] = {}
    for j, line in enumerate(other):
        at[line] = at.get(line, 0) | 1 << j
    all_ones = (1 << len(other)) - 1
    v, out = all_ones, []
    for line in own:
        u = v & at.get(line, 0)
        v = (v + u | v - u) & all_ones
        if keep:
            out.append(v)
    return out if keep else [v]


def _lengths(own: list[str], other: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of own with each beginning of other."""
    v, n = _rows(own, other, False)[0], len(other)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align(own: list[str], other: list[str], first: int, out: list[bool]) -> None:
    """Sets out at the places (from first on) of own's lines in a longest common subsequence."""
    while own and other and own[-1] == other[-1]:
        out[first + len(own) - 1] = True
        own, other = own[:-1], other[:-1]
    k = 0
    while k < min(len(own), len(other)) and own[k] == other[k]:
        out[first + k] = True
        k += 1
    own, other, first = own[k:], other[k:], first + k
    if not own or not other:
        return
    if len(own) > 1 and len(own) * len(other) > 8 * HELD:
        half = len(own) // 2
        sums = _lengths(own[:half], other) + _lengths(own[half:][::-1], other[::-1])[::-1]
        cut = int(sums.argmax())
        _align(own[:half], other[:cut], first, out)
        _align(own[half:], other[cut:], first + half, out)
        return
    rows = _rows(own, other, True)
    i, j = len(own), len(other)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> j - 1 & 1:
            i -= 1
        else:
            out[first + i - 1] = True
            i, j = i - 1, j - 1


def shared(own: list[str], other: list[str]) -> list[bool]:
    """Which of own's lines are in a longest common subsequence with other's.

    Lines that the other page does not have are left out first.  Time is the product of what is left, by words of bits;
    memory is bounded by HELD, beyond which the alignment is cut at its middle and each half aligned by itself.
    """
    out = [False] * len(own)
    both = set(own) & set(other)
    places = [i for i, x in enumerate(own) if x in both]
    got = [False] * len(places)
    _align([own[i] for i in places], [x for x in other if x in both], 0, got)
    for i, s in zip(places, got):
        out[i] = s
    return out


def main_text(lines: list[tuple[str, str]], is_shared: list[bool]) -> tuple[str, int, int, int]:
    """What is left of a page's lines, joined by newlines; how many lines went for being shared, how many that are not
    shared went by their elements, and how many shared ones elements kept."""
    kinds = {k for k, _ in lines}
    core = ARTICLE if ARTICLE in kinds else MAIN if MAIN in kinds else None
    stays = [k == core if core else k == LOOSE and not s for s, (k, _) in zip(is_shared, lines)]
    text = "\n".join(t for keep, (_, t) in zip(stays, lines) if keep)
    return text, *(sum(s == a and keep == b for s, keep in zip(is_shared, stays)) for a, b in ((True, False), (False, False), (True, True)))


@dataclass
class _Page:
    page_id: object
    url: str | None
    host: str
    path: str
    lines: list[tuple[str, str]]
    keys: list[str]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _pack(lines: list[tuple[str, str]]) -> bytes:
    """Lines compressed, for the way to other tasks; a line has no newline in it."""
    return zlib.compress("\n".join(k + t for k, t in lines).encode("utf-8", "surrogatepass"), 6)


def _unpack(data: bytes) -> list[tuple[str, str]]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(x[0], x[1:]) for x in text.split("\n")] if text else []


def _keys(lines: list[tuple[str, str]]) -> list[str]:
    """What stands for a line where only equality counts."""
    return [xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")) for _, t in lines]


def difference(page: _Page, before: _Page | None, after: _Page | None) -> tuple[str, int, int, int]:
    """main_text of a page given its neighbours."""
    near = [x for x in (before, after) if x is not None and x.host == page.host and page.host]
    best = max(near, key=lambda x: _common(page.path, x.path), default=None)
    return main_text(page.lines, shared(page.keys, best.keys) if best else [False] * len(page.lines))


def extract(df: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_elements, n_kept: one row per page.

    n_shared counts the lines deleted for being shared with the nearest page, n_elements those deleted by their elements
    alone, n_kept the shared ones that elements kept.  A null or empty html has an empty text.  A page whose url is null or
    has no host, or that is alone in its host, is paired with none.  Equal urls stand by page_id, then by the html's hash;
    repeated rows are pages of their own.  Other columns are left out.

    Pages are dealt out by ranges of host and path, so a large host is spread over many tasks; each page is parsed once,
    before it is dealt out, and each range has a copy of the page on either side, so nothing has to be joined afterwards.
    """
    prepare(df.sparkSession)
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^/?#]*://)?([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^/?#]*://)?[^/?#]*([^?#]*)", 1)
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), name.alias("host"), path.alias("path"))
    pages = pages.withColumn("tie", F.xxhash64("html"))

    def parsed(x: DataFrame) -> DataFrame:
        keep = [c for c in x.columns if c != "html"]
        return map_rows(x, lambda hs: [[_pack(lines_of(h)) for h in hs]], ["html"], [T.StructField("packed", T.BinaryType())], keep=keep, rows=64)

    key = ["host", "path", "page_id"]
    dealt = ranges(pages, key, ["tie"], before=True, after=True, made=parsed).select("page_id", "url", "host", "path", "packed", "__guest", "__part")
    counts = ("n_shared", "n_elements", "n_kept")
    schema = T.StructType([T.StructField("page_id", df.schema[page_id].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in counts)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, int, _Page]] = []  # the row before the one that waits for its next, and that one
        rows: list[tuple] = []

        def settle(following: tuple[int, int, _Page] | None):
            """The waiting row's result, now that the row after it is known."""
            if seen and not seen[-1][1]:
                part, _, page = seen[-1]
                near = [x[2] if x and x[0] == part else None for x in (seen[-2] if len(seen) > 1 else None, following)]
                rows.append((page.page_id, page.url, *difference(page, *near)))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return out

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for i, u, host, path, packed, guest, part in zip(*(x.to_pylist() for x in b.slice(at, 64).columns)):
                    lines = _unpack(packed)
                    now = (part, guest, _Page(i, u, host, path, lines, _keys(lines)))
                    settle(now)
                    seen = [*seen[-1:], now]
                if rows:
                    yield batch()
        settle(None)
        if rows:
            yield batch()

    return dealt.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *counts)
