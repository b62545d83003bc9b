"""The key-value store: a key-sorted Parquet snapshot and the statements since, made current by numbered pointer files.

A statement writes its folded operations only (a delta), so its cost follows what it changes, not what is stored. A read
leaves out the snapshot's keys that deltas name and adds the deltas' puts; deltas are broadcast while they are small, by
their file sizes, and joined by shuffle beyond that. Beyond ``MOST`` of them, deltas are folded into one, which costs what
they hold; ``compact`` merges them into a new snapshot, a rewrite of everything that is never part of a statement.

Pointer files are numbered, and one is made only if no other writer has made that number (a rename that does not
overwrite, on a local disk a hard link). A writer that comes second finds out: what does not depend on what was read is
appended to the newer state, anything else is a ``ConflictError``, and the statement is run again. So no acknowledged write
is lost, and readers see all of a statement or nothing.

All file access goes through Spark's Hadoop file system, so a store can be anywhere Spark can write and rename.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ConflictError, StoreError
from keyloom.operators.dml import PUT, fold

SCHEMA = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])
DELTA = "key string, phase int, value string"
POINTER = "_CURRENT."
#: Deltas are broadcast up to so many bytes, and folded into one beyond this number.
BROADCAST_BYTES, MOST = 32 << 20, 16


@dataclass(frozen=True)
class State:
    """What a pointer file says: its number, how many statements there were, the snapshot, and the deltas, oldest first."""

    number: int
    version: int
    names: tuple[str, ...]


class KvStore:
    """A folder of snapshots ``v=<number>-<id>`` and deltas ``d=<number>-<id>``; a pointer names those that count."""

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = False, read_only: bool = True, keep: int = 3) -> None:
        self.spark, self.path, self.read_only, self.keep = spark, path.rstrip("/"), read_only, keep
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._pointers():
            if not create_if_missing:
                raise StoreError(f"Failed to open store at '{path}': does not exist (create_if_missing is false)")
            empty = self._sorted(spark.createDataFrame([], SCHEMA), 0)
            try:
                self._point(State(0, 0, (empty,)))
            except ConflictError:
                pass  # another writer made it

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._root)] if self._fs.exists(self._root) else []

    def _pointers(self) -> list[int]:
        return sorted(int(n[len(POINTER) :]) for n in self._names() if n.startswith(POINTER) and n[len(POINTER) :].isdigit())

    def state(self) -> State:
        number = self._pointers()[-1]
        stream = self._fs.open(self._at(f"{POINTER}{number:08d}"))
        try:
            version, *names = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        return State(number, int(version), tuple(names))

    def current(self) -> list[str]:
        """The snapshot that counts and the deltas after it, oldest first."""
        return list(self.state().names)

    @staticmethod
    def _number(name: str) -> int:
        return int(name[2:].split("-")[0])

    @property
    def version(self) -> int:
        return self.state().version

    def versions(self) -> list[str]:
        """All snapshots and deltas in the folder, those kept for running readers included."""
        return sorted((n for n in self._names() if n[:2] in ("v=", "d=")), key=self._number)

    def _bytes(self, names: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._at(n)).getLength() for n in names)

    def _ops(self, deltas: tuple[str, ...]) -> DataFrame | None:
        """``(key, phase, value)`` of the deltas, the latest for each key."""
        ops = None
        for seq, n in enumerate(deltas):
            one = self.spark.read.schema(DELTA).parquet(f"{self.path}/{n}").withColumn("seq", F.lit(seq))
            ops = one if ops is None else ops.unionByName(one)
        if len(deltas) > 1:
            ops = ops.groupBy("key").agg(F.max_by(F.struct("phase", "value"), "seq").alias("op")).select("key", "op.phase", "op.value")
        return ops

    def read(self, state: State | None = None) -> DataFrame:
        base, *deltas = (state or self.state()).names
        kv = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{base}")
        if not deltas:
            return kv
        ops = self._ops(tuple(deltas))
        keys = ops.select("key")
        if self._bytes(deltas) <= BROADCAST_BYTES:
            keys = F.broadcast(keys)
        return kv.join(keys, "key", "left_anti").unionByName(ops.where(F.col("phase") == PUT).select("key", "value"))

    def get(self, key: str) -> str | None:
        r = self.read().where(F.col("key") == key).select("value").head()
        return r and r["value"]

    def _check(self) -> None:
        if self.read_only:
            raise StoreError("Cannot write to read-only connection")

    def commit(self, kv: DataFrame) -> int:
        """Make entries the store's whole content, as a new snapshot; returns its version."""
        self._check()
        was = self.state()
        self._point(State(was.number + 1, was.version + 1, (self._sorted(kv, was.number + 1),)))
        return was.version + 1

    def apply(self, ops: DataFrame, based_on: State | None = None) -> int:
        """Apply a statement's operations ``(key, phase, ord, value)`` as a delta; returns the version.

        With ``based_on``, the state they were made from, a write in between is a ``ConflictError``; without it they
        come after whatever was written.
        """
        self._check()
        now = based_on or self.state()
        name = f"d={now.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        fold(ops).sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        while True:
            try:
                self._point(State(now.number + 1, now.version + 1, (*now.names, name)))
                break
            except ConflictError:
                if based_on is not None:
                    self._fs.delete(self._at(name), True)
                    raise
                now = self.state()
        if len(now.names) > MOST:
            self._fold()
        return now.version + 1

    def _fold(self) -> None:
        """Make one delta of many; if another writer is faster, it is left to a later statement."""
        was = self.state()
        base, *deltas = was.names
        name = f"d={was.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._ops(tuple(deltas)).sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        try:
            self._point(State(was.number + 1, was.version, (base, name)))
        except ConflictError:
            self._fs.delete(self._at(name), True)

    def compact(self) -> None:
        """Merge the deltas into a new snapshot of the same version; deltas that come meanwhile stay deltas."""
        self._check()
        was = self.state()
        name = self._sorted(self.read(was), was.number + 1)
        while True:
            now = self.state()
            if now.names[: len(was.names)] != was.names:
                self._fs.delete(self._at(name), True)
                raise ConflictError("the store was rewritten by another writer")
            try:
                return self._point(State(now.number + 1, now.version, (name, *now.names[len(was.names) :])))
            except ConflictError:
                continue

    def _sorted(self, kv: DataFrame, n: int) -> str:
        """Write a snapshot, range-partitioned and sorted by key, so that key ranges prune files and row groups."""
        name = f"v={n:08d}-{uuid.uuid4().hex[:8]}"
        kv.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}")
        return name

    def _point(self, state: State) -> None:
        """Make a state current, unless its number is taken."""
        side, there = self._at(f"_{uuid.uuid4().hex}.next"), self._at(f"{POINTER}{state.number:08d}")
        out = self._fs.create(side, True)
        try:
            out.write(bytearray("\n".join([str(state.version), *state.names]).encode()))
        finally:
            out.close()
        side, there = self._fs.makeQualified(side), self._fs.makeQualified(there)
        taken = None
        try:
            if there.toUri().getScheme() == "file":  # its rename would overwrite
                path = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(path(there), path(side))
            else:
                files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark._jsc.hadoopConfiguration())
                files.rename(side, there, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if not self._fs.exists(there):
                raise
            taken = e
        finally:
            self._fs.delete(side, False)
        if taken is not None:
            raise ConflictError(f"version {state.number} of '{self.path}' was written by another writer") from taken
        for old in self.versions():
            if old not in state.names and self._number(old) <= state.number - self.keep:
                self._fs.delete(self._at(old), True)
        for number in self._pointers():
            if number <= state.number - self.keep:
                self._fs.delete(self._at(f"{POINTER}{number:08d}"), False)


class WriteBatch:
    """Ordered puts and deletes that are applied together, or not at all."""

    def __init__(self, store: KvStore) -> None:
        if store.read_only:
            raise StoreError("Cannot create writer for read-only connection")
        self._store, self._ops = store, []

    def put(self, key: str, value: str) -> None:
        self._ops.append((key, 1, len(self._ops), value))

    def delete(self, key: str) -> None:
        self._ops.append((key, 0, len(self._ops), None))

    @property
    def pending_count(self) -> int:
        return len(self._ops)

    @property
    def has_pending(self) -> bool:
        return bool(self._ops)

    def discard(self) -> None:
        self._ops = []

    def commit(self) -> None:
        """Apply what is pending, the last operation on a key winning; a second call finds nothing to do."""
        if not self._ops:
            return
        last = {op[0]: op for op in self._ops}
        ops = self._store.spark.createDataFrame(list(last.values()), "key string, phase int, ord long, value string")
        self._store.apply(ops)
        self._ops = []

    def __enter__(self) -> WriteBatch:
        return self

    def __exit__(self, *_) -> None:
        self.discard()
