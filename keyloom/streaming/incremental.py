"""Streams of key operations, applied to a store batch by batch, and streams of entries as attribute rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.tables import PivotTable
from keyloom.sources.store import KvStore


def maintain(ops: DataFrame, store: KvStore, checkpoint: str, after=None) -> StreamingQuery:
    """Apply a stream of ``(key, phase, ord, value)`` to a store, one delta for each batch that has rows.

    A batch that is delivered again after a failure sets the same keys to the same values, so it does no harm.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.apply(batch)
            if after:
                after(epoch)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_changes(table: PivotTable, entries: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """Counts of a stream of entries of a table by attribute and event-time window; late entries are dropped."""
    rows = entries.where(F.col("key").startswith(table.scan_prefix()))
    from keyloom.functions.keyexpr import parse

    p = parse(table.pattern, F.col("key"))
    rows = rows.where(p.valid).select(F.col(at).alias("at"), p.attr.alias("attr"))
    return rows.withWatermark("at", late).groupBy(F.window("at", width), "attr").agg(F.count(F.lit(1)).alias("n"))
