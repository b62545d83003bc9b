"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits over 3-word shingles; two link if they differ in at most ``radius`` (3) bits; documents of one
connected component are near-duplicates.

Finding the links among all distinct fingerprints without comparing all pairs: bits are dealt to six blocks, and two
fingerprints within 3 bits agree in at least three whole blocks, so each of the 20 choices of three blocks is a bucket
key of 32 or so bits, and no link is lost. Inside a bucket the pivot table decides: Hamming distances of every
fingerprint to ``PIVOTS`` reference fingerprints are computed once; by the triangle inequality a pair whose distances
to any reference differ by more than 3 cannot link and is discarded; survivors are verified bit by bit. A bucket is
walked as a breadth-first search over its unvisited fingerprints, so it yields a spanning forest (at most one link per
fingerprint), never all pairs. Only distinct fingerprints are bucketed: any number of exact copies is one entry, and a
ball of Hamming radius 3 bounds what near copies can add. Fingerprints that very many documents have, and components of very
many fingerprints, are broadcast to their rows (``common.spread``), so no key gathers its rows in one task.

Defined cases: null or blank text has no words and fingerprint zero, which links like any other; fewer words than a
shingle make one shingle; a null id is kept, and counts for no component's smallest id (null if no other is there);
repeated rows are kept; a very long text is hashed in slices, by one row at a time; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import components, cut, parts_of, spread, texts

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS, SAME = 6, 3
PIVOTS = 24
SLICE = 1 << 15


def hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order; fewer words than a shingle make one, no words none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 0 else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, max(n, 1))


def majority(h: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), SLICE):
        ones += np.unpackbits(h[i : i + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a text."""
    return majority(hashes(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t) for t in texts(b)], pa.int64())], names=["doc_id", "fp"])


def masks() -> list[int]:
    """The bit masks of the 20 bucket keys, as signed longs."""
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(blocks, SAME)]


def pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bucket_links(fps: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct uint64 fingerprints, as index pairs."""
    far = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = left[np.abs(far[left, 0] - far[i, 0]) <= radius]
            if len(near):
                near = near[np.abs(far[near] - far[i]).max(axis=1) <= radius]
            if len(near):
                near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
                for j in near:
                    yield int(i), int(j)
                front.extend(near)
                left = np.setdiff1d(left, near, assume_unique=True)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp) sorted by (t, key) -> links of each bucket."""
    refs = pivots()
    rest = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        head = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        size = np.diff(np.append(head, len(rows)))
        for i, n in zip(head[size > 1], size[size > 1], strict=True):
            fps = np.ascontiguousarray(rows[i : i + n, 2]).view(np.uint64)
            for x, y in bucket_links(fps, refs):
                a.append(int(rows[i + x, 2]))
                b.append(int(rows[i + y, 2]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("t", "key", "fp")], axis=1)])
        if not len(rows):
            continue
        at = len(rows) - int(np.argmax((rows[::-1, :2] != rows[-1, :2]).any(axis=1))) if (rows[:, :2] != rows[-1, :2]).any() else 0
        if at:
            yield links(rows[:at])
        rest = rows[at:]
    if len(rest):
        yield links(rest)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all of ``fps(fp)`` (distinct) as the whole graph of links does."""
    keys = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    dealt = dealt.repartition(parts_of(fps.sparkSession), "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_bucket_pairs, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.mapInArrow(_fingerprints, "doc_id long, fp long"))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    labelled = cut(nodes.join(found.hint("merge"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = spread(labelled.withColumnRenamed("n", "rows"), cut(least), "root").select("fp", "component_id", F.col("rows").alias("n"))
    out = spread(rows, cut(ids), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
