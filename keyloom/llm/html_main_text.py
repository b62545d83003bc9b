"""Main text of web pages by structure and by nearest-URL page differencing.

A page is read into blocks (text between block-level tags, white space folded), each with the chain of elements it
stands in. Three kinds follow: *furniture* (inside nav, header, footer, aside, form, script and the like, or inside an
element whose class or id names a menu, notice, advert or comment list), *article* (inside article or main, and no
furniture), *open* (neither). Within an article only sections are furniture by name, and only by a name that says nothing
else (``comments``, ``reader-comments``, but not ``entry-header``); headings and paragraphs never are. Pages of one host are put in the order of their URL paths and each is paired with the page
before it (the first of a host with the one after it); the lines of both are aligned by longest common subsequence, and
shared lines that are not article are deleted. A page without any article block keeps its open blocks that survive.

Differencing alone cannot give right results where a host's menus and notices differ from page to page, or where two
pages carry the same article, so it never deletes an article block and is not asked about furniture.

Pages are dealt by ranges of (host, path, id) as they come and read once, where they are paired; of the pages at the edges
of sorted partitions, two of each, only these are read again.

Defined cases: null html has the empty text; quotes only count after an equals sign, and a tag or comment that is not closed
ends with the page; a very long page is read by one row at a time; null urls form a host of their own; equal paths are ordered by page id;
repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import parts_of

#: Elements whose text is not read, elements that are furniture, and elements that end a block.
RAW = "script style template noscript iframe svg canvas object textarea title"
FURNITURE = frozenset("nav footer aside form button select dialog menu label fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Partitions whose edge pages (two of each) meet in one task.
GROUP = 8
#: Cells of a table of common subsequence lengths that is held whole.
TABLE = 1 << 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name furniture.
NAMES = frozenset("ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu menus nav navbar navigation newsletter notice notices pagination popup modal promo promoted related replies reactions respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets alert toast".split())
#: Elements that a name can make furniture within an article, and words that say no more about a name there.
SECTIONS = frozenset("div section ul ol dl table details figure header".split())
PLAIN = frozenset("area bar block box container inner list main outer panel reader readers section the user users wrap wrapper".split())
CLOSES_P = BLOCK - {"html", "body", "head"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW.split()}
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)


def _furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attrs):
        return True
    if inside and tag not in SECTIONS:
        return False
    for m in NAMED.finditer(attrs):
        value = next(x for x in m.groups() if x is not None).lower()
        for name in value.split() if inside else [value]:
            said = set(SPLIT.split(name)) - {""}
            if NAMES & said and (not inside or said <= NAMES | PLAIN and not said <= {"header", "search"} | PLAIN):
                return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each non-empty block of a page; kind is article, furniture or open."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # element, kind of its text
    at, kind = 0, "open"

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((kind, text))
            held.clear()

    while at < len(page):
        m = TOKEN.search(page, at)
        held.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        slash, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if not slash and tag in RAW_END:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            end()
        if slash:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID:
            if tag in CLOSES_P:  # an open paragraph ends, with the inline elements left open in it
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
                if k is not None and stack[k][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or k is not None and tag == stack[k][0] == "li":
                    del stack[k:]
            now = stack[-1][1] if stack else "open"
            if now != "furniture":
                if _furniture(tag, m[3], now == "article"):
                    now = "furniture"
                elif tag in ("article", "main"):
                    now = "article"
            stack.append((tag, now))
        now = stack[-1][1] if stack else "open"
        if now != kind:
            end()
            kind = now
    end()
    return out


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` stand in a longest common subsequence with ``b``; equal ends are matched first."""
    out = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
        out[x] = True
    there = set(b[lo:y])
    mine = [i for i in range(lo, x) if a[i] in there]
    own = {a[i] for i in mine}
    other = [s for s in b[lo:y] if s in own]
    if not mine:
        return out
    code: dict[str, int] = {}
    p = np.array([code.setdefault(a[i], len(code)) for i in mine])
    q = np.array([code[t] for t in other])
    for k in _aligned(p, q):
        out[mine[k]] = True
    return out


def _row(held: np.ndarray, symbol: int, q: np.ndarray) -> np.ndarray:
    """The next row of the table of common subsequence lengths."""
    out = np.zeros_like(held)
    out[1:] = np.maximum.accumulate(np.maximum(held[1:], (held[:-1] + 1) * (q == symbol)))
    return out


def _aligned(p: np.ndarray, q: np.ndarray) -> list[int]:
    """Places of ``p`` in a longest common subsequence with ``q``, in memory linear in their lengths."""
    if not len(p) or not len(q):
        return []
    if len(p) * len(q) > TABLE and len(p) > 1:
        mid = len(p) // 2
        up, down = np.zeros(len(q) + 1, np.int32), np.zeros(len(q) + 1, np.int32)
        for x in p[:mid]:
            up = _row(up, x, q)
        for x in p[mid:][::-1]:
            down = _row(down, x, q[::-1])
        at = int((up + down[::-1]).argmax())
        return _aligned(p[:mid], q[:at]) + [mid + k for k in _aligned(p[mid:], q[at:])]
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i, x in enumerate(p):
        table[i + 1] = _row(table[i], x, q)
    out, i, j = [], len(p), len(q)
    while i and j:
        if p[i - 1] == q[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def main_text(page: list[tuple[str, str]], neighbour: list[tuple[str, str]] | None) -> tuple[str, int]:
    """The text of a page's blocks given those of the page it is paired with, and how many blocks differencing deleted."""
    gone = shared([t for _, t in page], [t for _, t in neighbour]) if neighbour else [False] * len(page)
    gone = [g and k != "article" for (k, _), g in zip(page, gone, strict=True)]
    kind = "article" if any(k == "article" for k, _ in page) else "open"
    return "\n".join(t for (k, t), g in zip(page, gone, strict=True) if k == kind and not g), sum(gone)


KINDS = {"article": 0, "open": 1, "furniture": 2}
KIND = list(KINDS)


Page = tuple[tuple[int | None, str | None, str], list[tuple[str, str]]]  # (id, url, host), blocks


def _raw(b: pa.RecordBatch) -> Iterator[tuple[tuple[int | None, str | None, str], str | None]]:
    """(id, url, host) and html of each page."""
    for page_id, url, host, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
        yield (page_id, url, host), page


def _read(page: tuple) -> Page:
    return page[0], blocks(page[1] or "")


def _pages(b: pa.RecordBatch) -> Iterator[Page]:
    """Pages whose blocks were written by ``_edges``."""
    for page_id, url, host, kind, line in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "kind", "line")), strict=True):
        yield (page_id, url, host), [(KIND[k], t) for k, t in zip(kind, line, strict=True)]


def _text(page: Page, *neighbours: Page | None) -> tuple:
    """The row of a page that is paired with the first of the given ones that is of its host."""
    pair = next((n[1] for n in neighbours if n is not None and n[0][2] == page[0][2]), None)
    return *page[0][:2], *main_text(page[1], pair)


def _paired(edges: bool):
    """Pages in the order of (host, path, page id) -> their main texts, but for those that may have to be paired with a
    page of the next or the last partition; or, with ``edges``, those and the pages they may be paired with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = second = before = now = None
        out, seen = [], 0
        for b in batches:
            for raw in _raw(b):
                page = raw if edges else _read(raw)
                # ``now`` is between ``before`` and ``page``; the first of a partition is left to the second pass
                if seen > 1 and not edges:
                    out.append(_text(now, before, page))
                first = page if first is None else first
                second = page if seen == 1 else second
                before, now, seen = now, page, seen + 1
            if out:
                yield _texts(out)
                out = []
        # the last page is resolved here if the page before it is of its host
        alone = seen == 1 or seen > 1 and before[0][2] != now[0][2]
        if seen > 1 and not alone and not edges:
            yield _texts([_text(now, before)])
        if edges and seen:
            first, second, now = (p and _read(p) for p in (first, second, now))
            group, place = divmod(task, GROUP)
            rows = [(group, task, 0, first, True, second)]
            if seen > 1:
                rows.append((group, task, 1, now, alone, None))
            # a group's neighbours see its outer pages too
            if place == 0 and group:
                rows.append((group - 1, task, 0, first, False, None))
            if place == GROUP - 1:
                rows.append((group + 1, *rows[0 if seen == 1 else 1][1:4], False, None))
            yield _edges(rows)

    return run


EDGE = "part int, task int, seq int, page_id long, url string, host string, kind array<tinyint>, line array<string>, open boolean, after_kind array<tinyint>, after_line array<string>"


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    """Edge pages with whether they are still open, and the blocks of the page after them if it is of their host."""
    k, t = pa.list_(pa.int8()), pa.list_(pa.string())
    after = [a[1] if a is not None and a[0][2] == p[0][2] else None for *_, p, _, a in rows]
    pages = [r[3] for r in rows]
    cols = [
        *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)),
        pa.array([p[0][0] for p in pages], pa.int64()), pa.array([p[0][1] for p in pages], pa.string()), pa.array([p[0][2] for p in pages], pa.string()),
        pa.array([[KINDS[x] for x, _ in p[1]] for p in pages], k), pa.array([[x for _, x in p[1]] for p in pages], t), pa.array([r[4] for r in rows], pa.bool_()),
        pa.array([None if a is None else [KINDS[x] for x, _ in a] for a in after], k), pa.array([None if a is None else [x for _, x in a] for a in after], t),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in EDGE.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of partitions' edge pages, each in order -> the texts of the open ones."""
    before = held = part = None

    def done(page: Page, is_open: bool, after: Page | None, following: Page | None) -> list[tuple]:
        return [_text(page, before, after, following)] if is_open else []

    for b in batches:
        out = []
        afters = [None if k is None else [(KIND[x], t) for x, t in zip(k, ts, strict=True)] for k, ts in zip(b.column("after_kind").to_pylist(), b.column("after_line").to_pylist(), strict=True)]
        for group, page, is_open, after in zip(b.column("part").to_pylist(), _pages(b), b.column("open").to_pylist(), afters, strict=True):
            if held is not None:
                out += done(*held, page if group == part else None)
                before = held[0] if group == part else None
            part = group
            held = (page, is_open, None if after is None else (page[0], after))
        yield _texts(out)
    if held is not None:
        yield _texts(done(*held, None))


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["page_id", "url", "text", "n_differenced"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_differenced)`` of each row of ``pages(page_id, url, html)``."""
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    order = ["host", "path", "page_id"]
    dealt = rows.repartitionByRange(parts_of(pages.sparkSession), *order).sortWithinPartitions(*order)
    kinds = "page_id long, url string, text string, n_differenced long"
    edges = dealt.mapInArrow(_paired(True), EDGE).repartition(parts_of(pages.sparkSession), "part").sortWithinPartitions("part", "task", "seq")
    return dealt.mapInArrow(_paired(False), kinds).unionByName(edges.mapInArrow(_joined, kinds))
