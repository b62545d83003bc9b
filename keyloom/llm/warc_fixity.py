"""Merkle fixity audit of WARC replicas.

Each record of an archive file has a digest. Records are hashed, in the order of their offsets, into a tree of offset
ranges: 64 KiB, 1 MiB and 16 MiB of a file, the file, then groups of 256 files, groups of those, and the root. Two
replicas with equal roots are equal; otherwise only the children of mismatching nodes are compared, level by level,
down to the records. Every node has a bounded number of children, so no group is ever large.

Records are digested once for each replica; digests with their places, and each level above them, are written once in the
shared folder; texts never move.

Defined cases: null url or html is empty; a null page id is written as an empty id, and such records are dealt to files of
their own by their digests; a very long page is one record; repeated pages are records of their own, in the order of their digests; an empty table gives an empty audit, and every
record of the other replica is then missing or extra; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut

#: Pages of one archive file, and files (numbered below zero) that pages without an id are dealt to.
FILE_PAGES, LOOSE_FILES = 1024, 1 << 22
#: The date that records are written with.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of offset ranges as powers of two, and files in a group as powers of two.
RANGES = (16, 20, 24)
GROUPS = (8, 16, 24)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and bodies of concatenated records."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(re.fullmatch(r"\d+", head["Content-Length"])[0])
        out.append((head, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def records(pages: DataFrame, stored: Column | None = None) -> DataFrame:
    """``(page_id, file, offset, length, digest)`` of each page's record.

    ``stored`` is what a replica holds for the column ``record`` (default: the same bytes); places come from the record
    as written.
    """
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), record(page_id, F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    rows = rows.select("page_id", F.octet_length("record").cast("long").alias("length"), F.unhex(F.sha2("record", 256)).alias("written"), F.unhex(F.sha2(F.col("record") if stored is None else stored, 256)).alias("digest"))
    loose = -1 - F.pmod(F.xxhash64("written"), F.lit(LOOSE_FILES))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), loose))
    place = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "written")
    before = F.coalesce(F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("page_id", "file", before.alias("offset"), "length", "digest")


def _hash(*order: str) -> Column:
    """Digest of the children's digests with their order columns, in that order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "digest")))
    text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in order), F.hex(x["digest"]))), ";")
    return F.unhex(F.sha2(text, 256)).alias("digest")


def tree(recs: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """Levels from the smallest ranges to the root: their key columns, and nodes (keys, parent's keys, digest)."""
    levels: list[tuple[list[str], DataFrame]] = []
    rows, order = recs, ["offset", "length"]
    for i, bits in enumerate(RANGES):
        rows = rows.withColumn(f"r{i}", F.shiftright("offset" if i == 0 else f"r{i - 1}", bits if i == 0 else bits - RANGES[i - 1]))
        rows = cut(rows.groupBy("file", f"r{i}").agg(_hash(*order)))
        levels.append((["file", f"r{i}"], rows))
        order = [f"r{i}"]
    rows = cut(rows.groupBy("file").agg(_hash(*order)))
    levels.append((["file"], rows))
    last, was = "file", 0
    for i, bits in enumerate(GROUPS):
        rows = cut(rows.withColumn(f"g{i}", F.shiftright(last, bits - was)).groupBy(f"g{i}").agg(_hash(last)))
        levels.append(([f"g{i}"], rows))
        last, was = f"g{i}", bits
    levels.append(([], rows.agg(_hash(last))))
    return levels


def _parent(level: int) -> list[Column]:
    """The parent's keys of a node of a level, as columns over the node."""
    if level < len(RANGES) - 1:
        return [F.col("file"), F.shiftright(f"r{level}", RANGES[level + 1] - RANGES[level]).alias(f"r{level + 1}")]
    if level == len(RANGES) - 1:
        return [F.col("file")]
    if level == len(RANGES):
        return [F.shiftright("file", GROUPS[0]).alias("g0")]
    i = level - len(RANGES) - 1
    return [F.shiftright(f"g{i}", GROUPS[i + 1] - GROUPS[i]).alias(f"g{i + 1}")] if i + 1 < len(GROUPS) else []


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.select(*keys, F.col("digest").alias("da")), b.select(*keys, F.col("digest").alias("db"))
    return left.join(right, keys, "full").where(~F.col("da").eqNullSafe(F.col("db"))).select(*keys)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``(page_id, file, offset, length, kind)`` of records that differ: corrupt, missing (from the replica) or extra."""
    a, b = cut(primary), cut(replica)
    ta, tb = tree(a), tree(b)
    roots = [t[-1][1].first()["digest"] for t in (ta, tb)]
    if roots[0] == roots[1]:
        return a.limit(0).select("page_id", "file", "offset", "length", F.lit("corrupt").alias("kind"))
    bad = None
    for level in range(len(ta) - 2, -1, -1):
        keys = ta[level][0]
        na, nb = ta[level][1], tb[level][1]
        if bad is not None:
            na, nb = (_below(n, level, bad) for n in (na, nb))
        bad = cut(_differ(na, nb, keys))
    first = [F.col("file"), F.shiftright("offset", RANGES[0]).alias("r0")]
    ra, rb = (x.select("*", first[1]).join(bad, ["file", "r0"], "left_semi") for x in (a, b))
    ra = ra.select("file", "offset", F.col("page_id").alias("pa"), F.col("length").alias("la"), F.col("digest").alias("da"))
    rb = rb.select("file", "offset", F.col("page_id").alias("pb"), F.col("length").alias("lb"), F.col("digest").alias("db"))
    kind = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("corrupt")
    both = ra.join(rb, ["file", "offset"], "full").where(~(F.col("da").eqNullSafe(F.col("db")) & F.col("la").eqNullSafe(F.col("lb"))))
    return both.select(F.coalesce("pa", "pb").alias("page_id"), "file", "offset", F.coalesce("la", "lb").alias("length"), kind.alias("kind"))


def _below(nodes: DataFrame, level: int, bad: DataFrame) -> DataFrame:
    """The nodes of a level whose parent is among the mismatching ones."""
    up = _parent(level)
    names = bad.columns
    marked = nodes.select("*", *(c.alias(f"_{n}") for c, n in zip(up, names, strict=True)))
    on = [marked[f"_{n}"] == bad[n] for n in names]
    return marked.join(bad, on, "left_semi").select(nodes.columns)
