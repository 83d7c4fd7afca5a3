"""HTML extraction by nearest-URL page differencing.

1. A page becomes text lines, one for each block, with what their place in the markup says:
   in the article, in the main part, around these, or in a part that is never main text
   (menus, footers, forms, comments and so on, by element, role, class or id), as those differ
   from page to page and no comparison shows them.
2. Within each host pages are sorted by their URL's path, and each is paired with the
   neighbour whose path shares the longest prefix with its own; if that shares nearly all
   letters (a copy of the page), with the other one, unless it does so as well.
3. The pair's lines are aligned by a longest common subsequence. Shared lines are template,
   and are deleted: all of them outside the article, and inside it those of blocks that are
   no plain prose (any block but a paragraph, heading, list item, quotation or cell, or such
   a one that has a class or id): share bars, notices, lines of authors. Plain paragraphs that
   two articles share are text of both.
4. What is left of the article is the text; if there's no article, what is left of the main
   part; and if there's none, of the lines around.

Neighbours are sought among all pages of one host. Pages are dealt out by ranges of
(host, path, page_id), so a host with a third of all pages spreads over many tasks, and the
first and last page of each range travel to the range next to it as well: pairs don't depend
on where ranges end. A task holds three pages at a time; all other lines travel once.
"""

from __future__ import annotations

import bisect
import html
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, pieces, table, text_bytes

#: Bytes of pages in a range, and the fewest ranges.
RANGE_BYTES, RANGES = 32 << 20, 16
#: Pages drawn for each range, and at most, to choose where ranges end.
DRAWN, MOST_DRAWN = 40, 1_000_000
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
#: Kinds of lines: prose of the article, other blocks in it, in the main part, around these, never main text.
ARTICLE, MARKED, MAIN, AROUND, NEVER = range(5)
#: Pages that share this part of the letters that can be main text are copies, and tell nothing about templates.
COPIES = 0.8
_WORDS = {
    "raw": "script style noscript template iframe svg math canvas object embed textarea title select datalist audio video",
    "void": "area base br col embed hr img input link meta param source track wbr",
    "never": "nav footer aside form button menu dialog head",
    "inline": "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr",
    "space": "br td th img input",
    "class": "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget related recommended recommendations promo promotion ad ads advert adverts advertisement advertising banner sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus reply replies respond pagination pager toolbar copyright tags skip",
    "head": "header masthead topbar",
    "role": "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar",
}
RAW, VOID, NEVER_TAGS, INLINE, SPACED, CLASSES, HEADS, ROLES = (frozenset(_WORDS[k].split()) for k in ("raw", "void", "never", "inline", "space", "class", "head", "role"))
NAME = re.compile(r"[a-z0-9]+")
#: Blocks that hold prose; without class or id, a shared line of theirs inside the article is a quotation, no template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption article".split())
TAG_NAME, SPACE, ATTRIBUTE_NAME, BARE_VALUE = (re.compile(x) for x in (r"[^\s/>]+", r"[\s/]*", r"[^\s/>=]+|=", r"[^\s>]*"))
SPECIAL = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))


class Scanner:
    """Tags of a page one after the other, as the HTML standard reads them; every character is looked at a bounded number of times.

    A quoted value ends at its quote; where no such quote follows, it ends at white space or
    `>`. A quote elsewhere is part of a name. Markup that no `>` ends runs to the page's end.
    """

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def tag(self) -> tuple[str, bool, str, dict[str, str], bool] | None:
        """(text before the tag, whether it closes, its name or "", special attributes, whether it ends in />); None at the end."""
        page, n, begin, look = self.page, len(self.page), self.at, self.at
        while True:
            start = page.find("<", look)
            if start < 0 or start + 1 >= n:
                return None
            closing = page.startswith("/", start + 1)
            head = start + 1 + closing
            first = page[head : head + 1]
            if first.isascii() and first.isalpha():
                break
            if first in ("!", "?") or (closing and first):  # comments, declarations and what is read as such
                end = self.past("-->", head + 3) if page.startswith("!--", head) else self.past(">", head)
                self.at = end
                return page[begin:start], False, "", {}, False
            look = start + 1  # a character of the text
        m = TAG_NAME.match(page, head)
        name, at = m[0].lower(), m.end()
        found: dict[str, str] = {}
        while True:
            at = SPACE.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            m = ATTRIBUTE_NAME.match(page, at)
            key, at, value = m[0].lower(), m.end(), ""
            equals = SPACE.match(page, at).end() if page[at : at + 1].isspace() else at
            if page[equals : equals + 1] == "=" and key != "=":
                at = equals + 1
                while at < n and page[at].isspace():
                    at += 1
                quote = page[at : at + 1]
                if quote in ("\"", "'") and self.last[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = BARE_VALUE.match(page, at)
                    value, at = m[0].strip("\"'"), m.end()
            if key in SPECIAL:
                found.setdefault(key, value.lower())
        self.at = min(at + 1, n)
        return page[begin:start], closing, name, found, page[at - 1 : at] == "/"

    def past(self, what: str, at: int) -> int:
        """The place behind the next `what`, or the page's end."""
        end = self.page.find(what, at) if self.last[what[-1]] >= at else -1
        return len(self.page) if end < 0 else end + len(what)

    def skip(self, name: str) -> None:
        """To behind the closing tag of an element whose content is no markup."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, self.at)
        self.at = self.past(">", m.end()) if m else len(self.page)


def _never(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is never main text."""
    if tag in NEVER_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    names = set(NAME.findall(attributes.get("class", "") + " " + attributes.get("id", "")))
    if names & CLASSES or (not in_article and names & HEADS):
        return True
    return attributes.get("role") in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def lines(page: str) -> list[tuple[str, int]]:
    """Blocks of a page in order, white space made single, as (text, kind). Broken markup closes what it can. Linear in the page."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, the kind inside, and whether their lines are plain prose
    opened: Counter[str] = Counter()
    text: list[str] = []
    kind, plain, barred = AROUND, False, 0

    def end_block() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, MARKED if kind == ARTICLE and not plain else kind))
            text.clear()

    def close(size: int) -> None:
        nonlocal kind, plain, barred
        for t, _, _ in stack[size:]:
            opened[t] -= 1
            barred -= t in NEVER_TAGS
        del stack[size:]
        _, kind, plain = stack[-1] if stack else ("", AROUND, False)

    scan = Scanner(page)
    while (found := scan.tag()) is not None:
        before, closing, tag, attributes, empty = found
        text.append(before)
        if not tag:
            continue
        if tag in SPACED:
            text.append(" ")
        if tag in RAW:
            if not closing and not empty:
                scan.skip(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag not in INLINE and tag not in SPACED:
            end_block()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                outer = stack[k - 1][1] if k else AROUND
                if any(inside != outer for _, inside, _ in stack[k:]):
                    end_block()
                close(k)
            continue
        if tag in ("p", "li"):
            k = len(stack)
            while k and stack[k - 1][0] == tag:
                k -= 1
            close(k)
        inside = kind
        if _never(tag, attributes, kind in (ARTICLE, MAIN)):
            inside = NEVER
        elif tag in ("article", "main") and not (kind == NEVER and barred) and kind != ARTICLE:
            inside = ARTICLE if tag == "article" else MAIN
        if inside != kind:
            end_block()
        if tag not in INLINE:
            plain = tag in PROSE and not attributes.keys() & {"class", "id"}
        kind = inside
        stack.append((tag, kind, plain))
        opened[tag] += 1
        barred += tag in NEVER_TAGS
    text.append(page[scan.at :])
    end_block()
    return out


def shared(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Places in a and in b of a longest common subsequence of lines.

    Bit-parallel: a row is one integer with a bit for each line of b. Lines that the other
    page hasn't got are left out before, as are common ends.
    """
    in_a, in_b = set(a), set(b)
    ia, ib = [i for i, x in enumerate(a) if x in in_b], [i for i, x in enumerate(b) if x in in_a]
    found: list[tuple[int, int]] = []
    while ia and ib and a[ia[-1]] == b[ib[-1]]:
        found.append((ia.pop(), ib.pop()))
    k = 0
    while k < min(len(ia), len(ib)) and a[ia[k]] == b[ib[k]]:
        found.append((ia[k], ib[k]))
        k += 1
    found += [(ia[k + i], ib[k + j]) for i, j in _common([a[i] for i in ia[k:]], [b[i] for i in ib[k:]])]
    return {i for i, _ in found}, {j for _, j in found}


#: Bits of rows that are kept for tracing back; beyond it a is halved (Hirschberg, 1975).
TRACE_BITS = 1 << 30


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of a: the bits of b, clear where the longest common subsequence grows."""
    mask: dict[str, int] = {}
    for j, x in enumerate(b):
        mask[x] = mask.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & mask.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _growth(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of a with b[:0], b[:1], ..."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out, total = [0], 0
    for bit in reversed(bin(row)[2:].zfill(len(b))[-len(b) :] if b else ""):
        total += bit == "0"
        out.append(total)
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TRACE_BITS:
        half = len(a) // 2
        first, second = _growth(a[:half], b), _growth(a[half:][::-1], b[::-1])[::-1]
        k = max(range(len(b) + 1), key=lambda j: first[j] + second[j])
        return _common(a[:half], b[:k]) + [(half + i, k + j) for i, j in _common(a[half:], b[k:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1  # this line of b adds nothing
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:  # without this line of a, that of b adds nothing: they match
            j -= 1
            out.append((i, j))
    return out


@dataclass
class Page:
    """key: the host, whose pages are compared; path: what nearness is judged by; guest: only here to be compared with."""

    page_id: int | None
    url: str | None
    key: str
    path: str
    text: list[str]
    kind: list[int]
    part: int = 0
    guest: bool = False


def main_text(page: Page, others: list[Page]) -> tuple[str, int]:
    """The page's main text, and how many of its lines the page it is compared with shares.

    Compared with is the first of the others that is no copy; if all are, the first that
    isn't the same line for line.
    """
    found = [(*shared(page.text, other.text), other) for other in others]
    pick = next((f for f in found if not (copies(page, f[0]) and copies(f[2], f[1]))), None)
    pick = pick or next((f for f in found if len(f[0]) < len(page.text) or len(f[1]) < len(f[2].text)), None)
    gone = {i for i in pick[0] if page.kind[i] != ARTICLE} if pick else set()
    best = min((k for k in page.kind if k != NEVER), default=AROUND)
    wanted = (ARTICLE, MARKED) if best in (ARTICLE, MARKED) else (best,)
    text = "\n".join(t for i, (t, k) in enumerate(zip(page.text, page.kind, strict=True)) if k in wanted and i not in gone)
    return text, len((pick or found[0])[0]) if found else 0


def copies(page: Page, common: set[int]) -> bool:
    """Whether the shared lines are nearly all of what can be the page's text."""
    size = [len(t) * (k != NEVER) for t, k in zip(page.text, page.kind, strict=True)]
    return sum(size[i] for i in common) >= COPIES * sum(size)


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    m = re.match(HOST + "([^?#]*)", url or "")
    return (m[1].lower(), m[2] or "/") if m else ("", re.split("[?#]", url or "")[0])


#: A page's place in the order of all pages: host, path, whether it has an id, and the id or 0. Sorts as Spark does, nulls first.
Place = tuple[str, str, bool, int]
_PLACE = "key string, path string, has_id boolean, id long"


def _places(batch: pa.RecordBatch) -> list[Place]:
    return [(*place(u), i is not None, i or 0) for u, i in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)]


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _places(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["key", "path", "has_id", "id"])


def _ends(bounds: list[Place]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first and the last place of each range among the pages of a task."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, Place] = {}
        last: dict[int, Place] = {}
        for b in batches:
            for x in _places(b):
                k = bisect.bisect_right(bounds, x)
                first[k] = min(first.get(k, x), x)
                last[k] = max(last.get(k, x), x)
        rows = [(k, *x) for f in (first, last) for k, x in f.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["part", "key", "path", "has_id", "id"])

    return ends


def _ranges(pages: DataFrame, parts: int) -> tuple[list[Place], dict[Place, list[int]]]:
    """Where the ranges of pages(page_id, url) start, but for the first; and of each page at an end of its range, the range next to it.

    The pages drawn decide only how even ranges are.
    """
    n = pages.count()
    share = min(DRAWN * parts, MOST_DRAWN) / max(n, 1)
    some = pages if share >= 1 else pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = sorted(tuple(r) for r in some.mapInArrow(_drawn, _PLACE).collect())
    bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    here = F.struct("key", "path", "has_id", "id")
    ends = pages.mapInArrow(_ends(bounds), f"part int, {_PLACE}").groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    beside: dict[Place, list[int]] = {}
    for r in ends.collect():
        for at, to in ((r["first"], r["part"] - 1), (r["last"], r["part"] + 1)):
            if 0 <= to <= len(bounds):
                beside.setdefault(tuple(at), []).append(to)
    return bounds, beside


def _parse(bounds: list[Place], beside: dict[Place, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages as lines, each in its range, and once more, as a guest, in a range that it lies next to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                found = [lines(h or "") for h in part.column("html").to_pylist()]
                places = _places(part)
                to = [(k, bisect.bisect_right(bounds, x), False) for k, x in enumerate(places)]
                to += [(k, r, True) for k, x in enumerate(places) for r in beside.get(x, ())]
                rows = pa.array([k for k, _, _ in to], pa.int64())
                once = pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([x[0] for x in places], pa.string()), pa.array([x[1] for x in places], pa.string()), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[k for _, k in f] for f in found], pa.list_(pa.int8()))], names=["page_id", "url", "key", "path", "text", "kind"])
                columns = [once.column(c) if len(to) == once.num_rows else once.column(c).take(rows) for c in range(once.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array([r for _, r, _ in to], pa.int32()), pa.array([g for _, _, g in to], pa.bool_()), *columns], names=["part", "guest", *once.schema.names])

    return parse


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64())])


def _nearest(before: Page | None, page: Page, after: Page | None) -> list[Page]:
    """The neighbours on the page's host, the nearer by path first."""
    near = [p for p in (before, after) if p is not None and (p.part, p.key) == (page.part, page.key)]
    return sorted(near, key=lambda p: -len(os.path.commonprefix([p.path, page.path])))  # of equals the one before


def _compare() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages() -> Iterator[Page | None]:
            for b in batches:
                for a in range(0, b.num_rows, 256):
                    for r in b.slice(a, 256).to_pylist():
                        yield Page(r["page_id"], r["url"], r["key"], r["path"], r["text"], r["kind"], r["part"], r["guest"])
            yield None

        rows, before, page = [], None, None
        for after in pages():
            if page is not None and not page.guest:
                text, common = main_text(page, _nearest(before, page, after))
                rows.append((page.page_id, page.url, text, len(page.text), common))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            before, page = page, after
        yield _batch(rows)

    return compare


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_TEXTS), _TEXTS, strict=True)], schema=_TEXTS)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of pages(page_id long, url string, html string).

    Null html counts as empty, and gives an empty text; a null url's host and path are
    empty. Equal paths are neighbours by page_id; repeated rows come back once each. An
    empty table gives an empty one; other columns are left out.
    """
    bounded_batches(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parts = pieces(text_bytes(pages, "html"), RANGE_BYTES, RANGES)
    bounds, beside = _ranges(named.select("page_id", "url"), parts)
    parsed = named.mapInArrow(_parse(bounds, beside), "part int, guest boolean, page_id long, url string, key string, path string, text array<string>, kind array<tinyint>")
    near = parsed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "path", "page_id", "url", "text")
    found = near.mapInArrow(_compare(), "page_id long, url string, text string, n_lines long, n_shared long")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
