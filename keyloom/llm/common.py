"""Shared helpers of the training-data operators: row keys, checkpoints, graph components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value with more than one row in so many is hot.
HOT = 4096
#: Nodes of a graph whose neighbours are dealt to several groups.
HUBS = 1024
#: Rows of a text column handled by numpy at once.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local master may leave it unset and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _OWN.setdefault("folder", _OWN.get("folder") or tempfile.mkdtemp(prefix="keyloom-"))
    return at.rstrip("/")


_OWN: dict[str, str] = {}


#: Rows and bytes that a worker is given at once while a table is written; buffers for more are never given back.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of texts for workers are bounded in what is run meanwhile; the session's settings are put back."""
    was = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Its lineage ends there, it is computed once (a checkpoint computes its last stage twice), and its size is known.
    """
    at = f"{shared(df.sparkSession)}/keyloom-{uuid.uuid4().hex}"
    with bounded_batches(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(rid, doc_id, text, rest)``: rest is a struct of the columns ``carry``; rid is unique, never null and ordered like the id.

    Where ids are unique and not null, rid is the id itself. Otherwise rows are numbered in the order
    (id, nulls first; text): range partitions are counted, and each starts where the counts before it end.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.col("doc_id").cast("long")  # a constant would be moved above the shuffle
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    twice = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if twice.isEmpty():
        return base.select(F.col("doc_id").alias("rid"), "doc_id", "text", "rest")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = cut(base.repartitionByRange(parts_of(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("mono", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("mono"), 33).cast("int")
    sizes = sorted(ranged.groupBy(part.alias("p")).count().collect())
    starts, at = {}, 0
    for p, n in sizes:
        starts[p] = at
        at += n
    first = F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv])
    within = F.col("mono").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.select((F.element_at(first, part).cast("long") + within).alias("rid"), "doc_id", "text", "rest")


def spread(rows: DataFrame, sized: DataFrame, on: str) -> DataFrame:
    """``rows`` joined with ``sized(on, ..., n)`` on a column, where n counts the rows of a value and is left out.

    Values with more than one row in ``HOT`` are fewer than ``HOT``, whatever the input; these are broadcast, so that their
    rows stay where they are. The others are joined by a shuffle. ``sized`` is read several times.
    """
    total = sized.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot, cold = F.broadcast(sized.where(is_hot).drop("n")), sized.where(~is_hot).drop("n")
    left = rows.join(F.broadcast(sized.where(is_hot).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(left.join(cold.hint("merge"), on))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in both directions, sorted by (u, salt, v) -> each group's nodes linked to its least.

    A group with one neighbour, a smaller one, needs no row: that neighbour's group has one for it. ``open`` marks groups
    of more neighbours with a smaller one among them; where there are none, the edges are stars.
    """
    key, first, last = None, 0, 0
    for b in batches:
        u, salt, v = (np.asarray(b.column(c), dtype=np.int64) for c in ("u", "salt", "v"))
        if not len(u):
            continue
        head = np.append(key != (u[0], salt[0]), (u[1:] != u[:-1]) | (salt[1:] != salt[:-1]))
        at = np.flatnonzero(head)
        least = np.concatenate([np.full(at[0] if len(at) else len(u), first), np.repeat(v[at], np.diff(np.append(at, len(u))))])
        before = np.append(last, v[:-1])
        new = head | (v != before)
        low = np.minimum(u, least)
        linked = new & (v != low)
        opened = new & ~head & (least < u)
        own = opened & (before == least)  # the second neighbour
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([v[linked], u[own]])), pa.array(np.concatenate([low[linked], low[own]])), pa.array(np.concatenate([opened[linked], opened[own]]))],
            names=["u", "v", "open"],
        )
        key, first, last = (u[-1], salt[-1]), least[-1], v[-1]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)`` (longs); root is the smallest node.

    Each round links every node's neighbours, and the node itself, to the smallest of them (hash-to-min), in one shuffle
    and in a stream, until only stars are left. The ``HUBS`` nodes of most neighbours have them dealt to 64 groups, each of
    which is told the smallest of all; only these nodes reach the driver, and no other has over a ``HUBS``-th of all neighbours.
    """
    n = parts_of(edges.sparkSession)
    e = cut(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")).where("n > 100")
        hubs = degrees.orderBy(F.desc("n"), "u").limit(HUBS).collect()
        salt = F.when(F.col("u").isin([r["u"] for r in hubs]), F.pmod(F.xxhash64("v"), F.lit(64))).otherwise(0) if hubs else F.lit(0)
        both = both.withColumn("salt", salt.cast("long"))
        if hubs:  # each group of a node knows the smallest neighbour of the whole node
            both = both.unionByName(edges.sparkSession.createDataFrame([(r["u"], r["least"], k) for r in hubs for k in range(64)], "u long, v long, salt long"))
        dealt = both.repartition(n, "u", "salt").sortWithinPartitions("u", "salt", "v")
        e = cut(dealt.mapInArrow(_stars, "u long, v long, open boolean"))
        if not any(r["least"] < r["u"] for r in hubs) and not e.agg(F.max("open")).first()[0]:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def one_thread() -> None:
    """Have the matrix products of a task's worker run on one thread: further ones mostly wait, and their core is another task's."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to about ``most``; a larger row stands alone."""
    i = 0
    while i < len(sizes):
        j, total = i, 0
        while j < len(sizes) and (j == i or total + sizes[j] <= most):
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` entries, by doubling."""
    s = 1
    while 2 * s <= w:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: len(x) - (w - s)], x[w - s :]) if s < w else x


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k-gram of the symbols ``x``, built by doubling and then mixed."""
    h = x.astype(np.uint64) + np.uint64(1)
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    parts, size, power = [], 1, base
    left = k
    grams = h
    while True:
        if left & 1:
            parts.append((size, power, grams))
        left >>= 1
        if not left:
            break
        grams = grams[:-size] * np.uint64(power) + grams[size:]
        power = power * power & mask
        size *= 2
    n = len(x) - k + 1
    size, _, out = parts[-1]
    out, at = out[:n].copy(), size
    for size, power, grams in reversed(parts[:-1]):
        out *= np.uint64(power)
        out += grams[at : at + n]
        at += size
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out
