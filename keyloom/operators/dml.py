"""INSERT, UPDATE and DELETE as sets of key operations.

A statement becomes rows ``(key, phase, ord, value)``: phase 0 deletes a key, phase 1 puts a value. All deletes of a
statement come before its puts, and of several puts of a key the last row's wins. ``fold`` keeps one operation for each
key, ``apply_ops`` turns a snapshot into the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import keyexpr
from keyloom.operators.tables import ATTR, ID, PivotTable, ids

DEL, PUT = 0, 1
OLD, NEW = "__old_", "__new_"


def _ops(rows: DataFrame, key: Column, phase: int, value: Column | None = None) -> DataFrame:
    v = F.lit(None).cast("string") if value is None else value
    return rows.select(key.alias("key"), F.lit(phase).alias("phase"), F.col("ord"), v.alias("value"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``ord``, the order in which their operations count. It is fixed once the statement is written."""
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())


def _cells(table: PivotTable, rows: DataFrame, prefix: str = "", strict: bool = False) -> DataFrame:
    """``(ord, key, value)`` for each attribute column of rows; value is null where the cell is."""
    proj = table.projection
    cell = F.array(*(F.struct(F.lit(c.name).alias("attr"), c.type.write(F.col(f"`{prefix}{c.name}`")).alias("value")) for c in proj.attrs))
    caps = {c.name: c.type.write(F.col(f"`{prefix}{c.name}`")) for c in proj.identity}
    rows = rows.select("ord", *(caps[n].alias(f"{ID}{i}") for i, n in enumerate(table.pattern.capture_names)), F.explode(cell).alias("cell"))
    key = keyexpr.build(table.pattern, {n: F.col(f"{ID}{i}") for i, n in enumerate(table.pattern.capture_names)}, F.col("cell.attr"), strict)
    return rows.select("ord", key.alias("key"), F.col("cell.value").alias("value"))


def insert_ops(table: PivotTable, rows: DataFrame, strict: bool = False) -> DataFrame:
    """A put for each attribute that is not NULL; other stored attributes of the same identity stay."""
    rows = ordered(rows)
    missing = [c for c in table.projection.columns if c.name not in rows.columns]
    rows = rows.withColumns({c.name: F.lit(None).cast(c.type.spark) for c in missing})
    return _ops(_cells(table, rows, strict=strict).where("value is not null"), F.col("key"), PUT, F.col("value"))


def _stored(table: PivotTable, kv: DataFrame, who: DataFrame) -> DataFrame:
    """All stored keys of the identities (as stored texts) of ``who``, attributes of other tables included."""
    keys = ids(table.pattern)
    found = table.entries(kv)
    if not keys:
        return found.crossJoin(F.broadcast(who.select("ord").limit(1)))  # one row there is
    return found.select("key", *keys).join(who.groupBy(*keys).agg(F.max("ord").alias("ord")), keys)


def delete_ops(table: PivotTable, kv: DataFrame, old: DataFrame) -> DataFrame:
    """Delete all keys of the rows of a scan with ``raw_ids``."""
    return _ops(_stored(table, kv, ordered(old)), F.col("key"), DEL)


def update_ops(table: PivotTable, kv: DataFrame, old: DataFrame, changes: dict[str, Column], strict: bool = False) -> DataFrame:
    """Set columns of the rows of a scan with ``raw_ids``; ``changes`` are expressions over the old row.

    With the identity unchanged, attributes are put or, if NULL, deleted, and undeclared ones stay. With a new identity
    all old keys go and the new row is inserted.
    """
    proj, keys = table.projection, ids(table.pattern)
    rows = ordered(old)
    new = {c.name: changes[c.name].cast(c.type.spark) if c.name in changes else F.col(f"`{c.name}`") for c in proj.columns}
    rows = rows.select("ord", *keys, *(new[c.name].alias(f"{NEW}{c.name}") for c in proj.columns), *(F.col(f"`{c.name}`").alias(f"{OLD}{c.name}") for c in proj.identity))
    same = F.lit(True)
    for c in proj.identity:
        same = same & F.col(f"`{NEW}{c.name}`").eqNullSafe(F.col(f"`{OLD}{c.name}`"))
    kept, moved = rows.where(same), rows.where(~same)
    # an unchanged identity keeps the texts it is stored under
    stored = kept.select("ord", *keys, F.explode(F.array(*(F.struct(F.lit(c.name).alias("attr"), c.type.write(F.col(f"`{NEW}{c.name}`")).alias("value")) for c in proj.attrs))).alias("cell"))
    key = keyexpr.build(table.pattern, {n: F.col(f"{ID}{i}") for i, n in enumerate(table.pattern.capture_names)}, F.col("cell.attr"))
    cells = stored.select("ord", key.alias("key"), F.col("cell.value").alias("value"))
    puts = _ops(cells.where("value is not null"), F.col("key"), PUT, F.col("value"))
    gone = _ops(cells.where("value is null"), F.col("key"), DEL)
    if not keys or not any(c.name in changes for c in proj.identity):
        return puts.unionByName(gone)
    away = _ops(_stored(table, kv, moved), F.col("key"), DEL)
    there = _ops(_cells(table, moved, NEW, strict).where("value is not null"), F.col("key"), PUT, F.col("value"))
    return puts.unionByName(gone).unionByName(away).unionByName(there)


def raw_put_ops(rows: DataFrame) -> DataFrame:
    """Puts of ``(key, value)``: a NULL key is an error, a NULL value is stored as the empty string."""
    key = F.when(F.col("key").isNull(), F.raise_error(F.lit("key column cannot be NULL")).cast("string")).otherwise(F.col("key"))
    return _ops(ordered(rows), key, PUT, F.coalesce("value", F.lit("")))


def raw_update_ops(old: DataFrame, value: Column | None) -> DataFrame:
    """Put new values under the old keys; a changed key is ignored."""
    return _ops(ordered(old), F.col("key"), PUT, F.coalesce(F.col("value") if value is None else value.cast("string"), F.lit("")))


def raw_delete_ops(old: DataFrame) -> DataFrame:
    return _ops(ordered(old), F.col("key"), DEL)


def fold(ops: DataFrame) -> DataFrame:
    """``(key, phase, value)``: the operation that counts for each key."""
    last = F.max_by(F.struct("phase", "value"), F.struct("phase", "ord")).alias("op")
    return ops.groupBy("key").agg(last).select("key", "op.phase", "op.value")


def apply_ops(kv: DataFrame, ops: DataFrame) -> DataFrame:
    """The snapshot after a statement: one join on the key, hash-partitioned on both sides."""
    done = fold(ops).select("key", F.col("phase").alias("__phase"), F.col("value").alias("__value"))
    both = kv.join(done, "key", "full_outer")
    value = F.when(F.col("__phase") == PUT, F.col("__value")).when(F.col("__phase").isNull(), F.col("value"))
    return both.where(F.col("__phase").isNull() | (F.col("__phase") == PUT)).select("key", value.alias("value"))


def counters(ops: DataFrame) -> dict[str, int]:
    """Keys written and deleted by a statement, before folding."""
    n = {r["phase"]: r["count"] for r in ops.groupBy("phase").count().collect()}
    return {"keys_written": n.get(PUT, 0), "keys_deleted": n.get(DEL, 0)}


__all__ = ["ATTR", "apply_ops", "counters", "delete_ops", "fold", "insert_ops", "raw_delete_ops", "raw_put_ops", "raw_update_ops", "update_ops"]
