"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With weight w (its share of the remaining weights), the i-th block of a source
may not be placed before slot floor((i-1)/w) and must be placed before slot ceil(i/w); each slot takes the released
block with the earliest deadline (ties: the heavier source, then its name). Weights are whole multiples of 1 / ``PERIOD``
that sum to 1, so at every slot each source is less than one block away from its target, and after ``PERIOD`` slots all are
exactly at it and the schedule repeats. When a source runs out, the others share its weight and their windows start anew
from there; every row is placed once.

So the schedule is a list of phases, one for each source that runs out, and one period of each phase; no more than that
is ever made in one place, whatever the number of rows. A block finds its phase by its number, and its slot by its
number modulo the blocks its source has in a period. Rows get their numbers without a task ever holding a source: they
are dealt to buckets by a hash of their row key, numbered in their bucket, and a running sum of bucket counts gives
each bucket its first number.

Sources are a list that can be named with weights: their counts are collected, and phases times sources are broadcast.

Defined cases: null source is a source of its own, sorted first; a null id is kept; repeated rows each get a place;
sources without a weight take the mean of the given ones, weights must be positive; a source lighter than 1 / ``PERIOD``
gets that much; an empty table gives an empty result; extra columns are ignored; texts do not matter.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import keyed

BLOCK_ROWS = 64
#: Rows of a source's bucket, about.
BUCKET_ROWS = 128
#: Targets weigh a source by its rows to this power unless weights are given.
TEMPERATURE = 0.5
#: Slots after which a phase's schedule repeats.
PERIOD = 1 << 17


@dataclass
class Phase:
    """Slots from ``start`` on, until a source runs out: blocks each source has in a period, those placed before, and one
    period (or as much of it as is used) as sources by slot."""

    start: int
    share: dict[str | None, int]
    done: dict[str | None, int]
    period: list[str | None]
    length: int


def shares(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Whole shares of a period, by the largest remainders; every source has one at least."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (out[s] - exact[s], s is not None, s or ""))  # the most wanting first
    for s in order[: max(0, period - sum(out.values()))]:
        out[s] += 1
    while (over := sum(out.values()) - period) > 0:  # many sources had less than one
        s = max(out, key=lambda s: (out[s], s is not None, s or ""))
        out[s] -= min(over, max(1, out[s] // 2))
    return out


def first_period(share: dict[str | None, int], left: dict[str | None, int], period: int) -> list[str | None]:
    """Sources by slot: one period, or less if a source has no blocks left before it ends."""
    name = {s: (-share[s], i) for i, s in enumerate(sorted(share, key=lambda s: (s is not None, s or "")))}
    waiting = [(0, name[s], s, 0) for s in share]  # by release
    ready: list[tuple[int, tuple[int, int], str | None, int]] = []  # by deadline
    heapq.heapify(waiting)
    out: list[str | None] = []
    while len(out) < period:
        while waiting and waiting[0][0] <= len(out):
            _, k, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // share[s]), k, s, i))
        _, k, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 == left[s]:
            break
        heapq.heappush(waiting, ((i + 1) * period // share[s], k, s, i + 1))
    return out


def phases(blocks: dict[str | None, int], weights: dict[str | None, float], period: int = PERIOD) -> Iterator[Phase]:
    """The phases of a schedule of ``blocks`` by source."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start = dict.fromkeys(left, 0), 0
    while left:
        size = max(period, len(left))
        share = shares({s: weights[s] for s in left}, size)
        slots = first_period(share, left, size)
        if len(slots) < size or left[slots[-1]] == share[slots[-1]]:
            length = len(slots)  # a source ran out in its first period
        else:  # whole periods, and then up to the first last block
            at: dict[str | None, list[int]] = {s: [] for s in left}
            for slot, s in enumerate(slots):
                at[s].append(slot)
            length = min((n - 1) // share[s] * size + at[s][(n - 1) % share[s]] for s, n in left.items()) + 1
        whole, rest = divmod(length, size)
        had = Counter(slots[:rest])
        yield Phase(start, share, dict(done), slots[: min(length, size)], length)
        for s in list(left):
            n = whole * share[s] + had[s]
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += length


def schedule(blocks: dict[str | None, int], weights: dict[str | None, float], period: int = PERIOD) -> Iterator[tuple[int, str | None, int, int, int]]:
    """(slot, source, block, release, deadline) of each block in the order of slots."""
    for p in phases(blocks, weights, period):
        size, had = sum(p.share.values()), Counter()
        for slot in range(p.length):
            s = p.period[slot % size]
            i, q = had[s], p.share[s]
            had[s] += 1
            yield p.start + slot, s, p.done[s] + i, p.start + i * size // q, p.start - (-(i + 1) * size // q)


def numbered(docs: DataFrame, counts: dict[str | None, int]) -> DataFrame:
    """``(doc_id, source, n)``: n counts the rows of a source from 0, in the order of a hash of the row key."""
    most = max(counts.values(), default=0)
    rows = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    rows = keyed(rows, ["source"]).select("rid", "doc_id", F.col("rest.source").cast("string").alias("source"))
    h = F.xxhash64("rid")
    rows = rows.withColumn("bucket", F.pmod(h, F.lit(max(1, -(-most // BUCKET_ROWS)))))
    sizes = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("source", "bucket", (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("start"))
    within = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(h, "rid")) - 1)
    at = (within.source.eqNullSafe(starts.source)) & (within.bucket == starts.bucket)
    return within.join(starts, at).select("doc_id", within.source, (F.col("start") + F.col("rn")).cast("long").alias("n"))


def _period_rows(blocks: dict[str | None, int], weights: dict[str | None, float], period: int):
    """One period of each phase as rows (phase, source, j, at): a source's j-th block of a period is in slot ``at`` of it."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["phase", "owner", "j", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            for k, p in enumerate(phases(blocks, weights, period)):
                had, rows = Counter(), []
                for at, s in enumerate(p.period):
                    rows.append((k, s, had[s], at))
                    had[s] += 1
                yield batch(rows)

    return run


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``(doc_id, source, position, block, slot, release, deadline)``: the place of each row of ``docs(doc_id, source)``."""
    spark = docs.sparkSession
    counts = {r["source"]: r["n"] for r in docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in counts.items()}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    mean = sum(weights.values()) / len(weights) if weights else 1.0
    weights = {s: weights.get(s, mean) for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    # what a phase says of each of its sources; rows that last blocks lack of a whole one make later positions smaller
    said, lacking = [], 0
    for k, p in enumerate(phases(blocks, weights, period)):
        size = sum(p.share.values())
        placed = Counter(p.period[: p.length % size])
        for s, q in p.share.items():
            n = p.length // size * q + placed[s]
            said.append((s, k, p.done[s], p.done[s] + n, q, size, p.start, lacking))
            if p.done[s] + n == blocks[s]:
                ended = blocks[s] * block_rows - counts[s]
        lacking += ended
    parts = F.broadcast(spark.createDataFrame(said, "owner string, phase long, lo long, hi long, q long, size long, start long, lacking long"))
    periods = spark.range(1, numPartitions=1).mapInArrow(_period_rows(blocks, weights, period), "phase long, owner string, j long, at long")
    rows = numbered(docs, counts).withColumn("block", F.expr(f"n div {block_rows}"))
    rows = rows.join(parts, rows.source.eqNullSafe(parts.owner) & (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))).drop("owner")
    rows = rows.withColumn("i", F.col("block") - F.col("lo")).withColumn("j", F.col("i") % F.col("q"))
    at = (rows.phase == periods.phase) & rows.source.eqNullSafe(periods.owner) & (rows.j == periods.j)
    rows = rows.join(periods, at).withColumn("slot", F.col("start") + F.expr("i div q") * F.col("size") + F.col("at"))
    first = F.col("slot") * block_rows - F.col("lacking")
    return rows.select(
        "doc_id", "source", (first + F.col("n") % block_rows).alias("position"), "block", "slot",
        F.expr("start + i * size div q").alias("release"), F.expr("start + ((i + 1) * size + q - 1) div q").alias("deadline"),
    )
