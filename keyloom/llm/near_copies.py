"""SimHash near-dedup by shingle similarity: documents whose sets of five-word shingles are ``LEAST`` (0.8) alike or more.

64 bits cannot tell 0.8 from less: such pairs differ in about ten bits, a distance at which no choice of whole blocks is
left to bucket by. So the pivot tables of ``simhash`` find the copies within its radius, and two further kinds of
candidates complete them. All candidates are verified by the exact Jaccard similarity of their shingle sets.

1. Texts with the same set are folded. Candidates are the links of the pivot tables, and each member of a bucket of minimum
   hashes (``BANDS`` keys of ``ROWS`` each; a pair at 0.8 shares none with probability (1 - 0.8**4)**24 = 3e-6) with
   the bucket's smallest member. So a large group of near copies takes one comparison a member and key.
2. Buckets that this leaves in several components are settled by an exact prefix join over the documents in them: two sets
   of similarity 0.8 share one of their first shingles in any common order, of which a set of n has n - ceil(0.8 n) + 1,
   and the place at which they first share one bounds how many they can share. The order puts shingles last that many
   documents hold, so an edited copy comes with its own edits first, and those that cannot reach 0.8 with any size of set
   in a list are left out of it; pairs that are in one component already are not compared.

Frequencies for the order come from a table of ``CELLS`` counters over hashes, summed in two steps; its size is fixed and it
changes costs only, as any order gives the same links.

Defined cases: null or blank text has the empty set, which equals any other empty set; fewer words than a shingle make one
shingle; a very long text is held by one row at a time; ids are unique and not null (see ``common.keyed``); ties do not
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import simhash
from keyloom.llm.common import HOT, components, cut, parts_of, spread, texts

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 4
SEED = 42
SLICE = 512
CELLS = 1 << 18
#: A table of counters is summed in so many blocks.
BLOCKS = 16
#: Ids that are broadcast at most, counted first; more are joined by a shuffle.
FEW = 1 << 18


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(simhash.hashes(text, SHINGLE))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def keys(x: np.ndarray) -> list[int]:
    """The band keys of a set."""
    if not len(x):
        return []
    by = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), SLICE):
        np.minimum(least, (by[:, None] * x[None, i : i + SLICE]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, fps, bands = [], [], []
        for t in texts(b):
            x = shingles(t)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            fps.append(simhash.majority(x) if len(x) else 0)
            bands.append(keys(x))
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["rid", "digest", "fp", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: dict[str, np.ndarray] = {}
        near = []
        for s, t in zip(texts(b, "s"), texts(b, "t"), strict=True):
            if len(held) > 1000:
                held.clear()
            for x in (s, t):
                if x not in held:
                    held[x] = shingles(x)
            near.append(jaccard(held[s], held[t]) >= LEAST)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``ids(rid, ...)``, which are broadcast if a count finds them few."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), "rid")


def links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts in ``rows(rid, text)`` are near copies; ``pairs`` is read several times.

    A document that many are compared with is joined in as many pieces as its share of the pairs asks for; there are fewer
    than ``HOT`` such documents.
    """
    rows = among(rows, cut(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()))
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    many = F.broadcast(cut(sizes.where(F.col("n") * HOT > total).select("a", (F.col("n") * HOT / max(total, 1)).cast("int").alias("pieces"))))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).cast("int")
    left = pairs.join(many, "a", "left").select("a", "b", salt.alias("salt"))
    first = rows.select(F.col("rid").alias("a"), F.col("text").alias("s")).join(many, "a", "left")
    first = first.select("a", "s", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("salt"))
    both = left.join(first.hint("merge"), ["a", "salt"])
    both = both.join(rows.select(F.col("rid").alias("b"), F.col("text").alias("t")).hint("merge"), "b").select("a", "b", "s", "t")
    return cut(both.mapInArrow(_verified, "a long, b long"))


def _cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> how many of them hold a shingle of each cell, by block of cells."""
    total = np.zeros(CELLS, np.float32)
    for b in batches:
        for t in texts(b):
            np.add.at(total, _cells(shingles(t)), np.float32(1))
    if total.any():
        yield _tables(enumerate(np.split(total, BLOCKS)))


def _tables(rows) -> pa.RecordBatch:
    block, table = zip(*((i, x.tobytes()) for i, x in rows), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(table, pa.binary())], names=["block", "table"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, table in zip(b.column("block").to_pylist(), b.column("table").to_pylist(), strict=True):
            x = np.frombuffer(table, np.float32)
            total[block] = total[block] + x if block in total else x
    if total:
        yield _tables(total.items())


def loads(rows: DataFrame) -> np.ndarray:
    """About how many of ``rows(text)`` hold a shingle of each cell."""
    n, kinds = parts_of(rows.sparkSession), "block int, table binary"
    tables = rows.select("text").mapInArrow(_counted, kinds).withColumn("salt", F.spark_partition_id() % max(1, n // BLOCKS))
    once = tables.repartition(n, "block", "salt").select("block", "table").mapInArrow(_summed, kinds)
    out = np.zeros((BLOCKS, CELLS // BLOCKS), np.float32)
    for r in once.repartition(min(n, BLOCKS), "block").mapInArrow(_summed, kinds).collect():
        out[r["block"]] = np.frombuffer(r["table"], np.float32)
    return out.reshape(-1)


def prefix(x: np.ndarray, load: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a set that is ``LEAST`` alike has one: rare cells first, then by hash."""
    k = len(x) - int(np.ceil(LEAST * len(x) - 1e-9)) + 1
    return x[np.lexsort((x, load[_cells(x)]))[:k]]


def _prefixes(load: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in texts(b)]
            first = [prefix(x, load) for x in sets]
            n = np.array([len(p) for p in first], np.int64)
            place = np.concatenate([np.arange(k) for k in n]) if len(n) else n
            key = np.concatenate(first).view(np.int64) if len(n) else n
            own = [np.repeat(np.asarray(b.column(c), np.int64), n) for c in ("rid", "root")]
            cols = [pa.array(key, pa.int64()), *(pa.array(x, pa.int64()) for x in own), pa.array(np.repeat([len(x) for x in sets], n), pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "root", "size", "place"])

    return run


def may_reach(size: str, place: str, other: str) -> str:
    """SQL: a set of ``size`` that first shares its shingle at ``place`` may be ``LEAST`` alike to one of size ``other`` (or of more)."""
    return f"{size} - {place} >= greatest({other}, {LEAST} * {size}) * {LEAST} / {1 + LEAST} + {size} * {LEAST} / {1 + LEAST} - 1e-6"


def cross_pairs(opened: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``opened(rid, root, text)`` of different roots that hold all near copies among them."""
    dealt = cut(opened.mapInArrow(_prefixes(loads(opened)), "key long, node long, root long, size int, place int"))
    mixed = lambda rows: rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "least", "n")
    kept = cut(spread(dealt, cut(mixed(dealt)), "key").where(may_reach("size", "place", "least")).drop("least"))
    kept = cut(spread(kept, cut(mixed(kept)), "key").drop("least"))
    other = kept.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "place")))
    near = f"root < root_b and least(size, size_b) >= {LEAST} * greatest(size, size_b) - 1e-6 and least(size - place, size_b - place_b) >= (size + size_b) * {LEAST} / {1 + LEAST} - 1e-6"
    return kept.join(other.hint("merge"), "key").where(near).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def later_copies(rows: DataFrame) -> DataFrame:
    """The ``rid`` of each of ``rows(rid, text)`` that is not the smallest of its component of near copies."""
    rows = rows.select("rid", "text")
    sketches = cut(rows.mapInArrow(_sketches, "rid long, digest binary, fp long, keys array<long>"))
    single = sketches.groupBy("digest").agg(F.min(F.struct("rid", "fp", "keys")).alias("x"))
    single = cut(single.select(F.col("x.rid").alias("node"), "x.fp", "x.keys"))
    same = sketches.select("rid").join(single.select(F.col("node").alias("rid")).hint("merge"), "rid", "left_anti")
    # equal fingerprints are a bucket like those of equal minimum hashes; others within the radius come from the pivot tables
    by_fp = cut(single.groupBy("fp").agg(F.min("node").alias("first")))
    ends = [by_fp.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}")).hint("merge") for c in ("a", "b")]
    within = simhash.links(by_fp.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    dealt = single.select("node", F.explode(F.array_append("keys", F.col("fp"))).alias("key"))
    first = cut(dealt.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    dealt = cut(spread(dealt, first, "key"))
    tried = cut(dealt.where("node <> a").select("a", F.col("node").alias("b")).unionByName(within).distinct())
    found = links(tried, rows)
    roots = cut(components(found))
    placed = dealt.select("key", "node").join(roots.withColumnRenamed("root", "at").hint("merge"), "node", "left").select("key", "node", F.coalesce("at", "node").alias("root"))
    placed = cut(placed)
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    still = cut(spread(placed, cut(split), "key").select(F.col("node").alias("rid"), "root").distinct())
    cross = cut(cross_pairs(among(rows, still)).join(tried.hint("merge"), ["a", "b"], "left_anti"))
    more = links(cross.select("a", "b"), rows)
    # what is left is to join the components that these links connect
    own = roots.select(F.col("node"), F.col("root"))
    ends = more.join(own.select(F.col("node").alias("a"), F.col("root").alias("x")).hint("merge"), "a", "left").join(own.select(F.col("node").alias("b"), F.col("root").alias("y")).hint("merge"), "b", "left")
    joined = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    later = roots.unionByName(joined).where("node <> root").select(F.col("node").alias("rid"))
    return later.unionByName(same).distinct()
