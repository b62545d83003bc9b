"""``spark.read.format("keyloom_kv")``: a store as a data source that can take SQL filters on the key down to its files.

Options: ``path`` (a store on a path that pyarrow can open), ``push_filters`` (default false). Spark checks pushed filters
again. Spark 4.1 keeps what was pushed with the loaded relation and reads with it again, whatever the next query over the
same DataFrame asks; so filters are only pushed where that is asked for, and then each load serves one query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "keyloom_kv"


class KvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        push = self.options.get("push_filters", "false").lower() == "true"
        return PushingReader(self.options["path"]) if push else KvReader(self.options["path"])


class KvReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.terms = path, []

    def partitions(self) -> list[InputPartition]:
        """A partition for each file of the snapshot, with the range of keys from its first key to the next file's.

        Files are ranges of keys, so a task needs no more of the deltas than its own range; the first and the last range
        are open.
        """
        import pyarrow.dataset as ds
        import pyarrow.fs as pfs

        fs, root = _filesystem(self.path)
        last = max(f.path for f in fs.get_file_info(pfs.FileSelector(root)) if f.base_name.startswith("_CURRENT."))
        with fs.open_input_file(last) as f:
            _, base, *deltas = f.read().decode().split()
        firsts = []
        for name in ds.dataset(f"{root}/{base}", filesystem=fs, format="parquet").files:
            head = ds.dataset(name, filesystem=fs, format="parquet").head(1, columns=["key"])
            if head.num_rows:
                firsts.append((head.column("key")[0].as_py(), name))
        firsts.sort()
        bounds = [None, *(k for k, _ in firsts[1:]), None]
        return [InputPartition((name, deltas, lo, hi)) for name, lo, hi in zip([n for _, n in firsts] or [""], bounds, bounds[1:], strict=False)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        fs, root = _filesystem(self.path)
        file, deltas, lo, hi = partition.value
        key = ds.field("key")
        tests = [key >= lo] * (lo is not None) + [key < hi] * (hi is not None)
        for op, v in self.terms:
            tests.append({"=": lambda: key == v, ">": lambda: key > v, ">=": lambda: key >= v, "<": lambda: key < v, "<=": lambda: key <= v, "in": lambda: key.isin(list(v)), "^": lambda: key >= v}[op]())  # noqa: B023
        test = None
        for one in tests:
            test = one if test is None else test & one
        last: dict[str, tuple[int, str | None]] = {}  # of the keys in this range that pass the filters
        for name in deltas:
            for b in ds.dataset(f"{root}/{name}", filesystem=fs, format="parquet").to_batches(filter=test):
                for r in b.to_pylist():
                    last[r["key"]] = r["phase"], r["value"]
        puts = [(k, v) for k, (phase, v) in last.items() if phase]
        if puts:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in puts], pa.string()) for i in (0, 1)], names=["key", "value"])
        changed = pa.array(list(last), pa.string())
        for b in ds.dataset(file, filesystem=fs, format="parquet").to_batches(columns=["key", "value"], filter=test) if file else ():
            yield b.filter(pc.invert(pc.is_in(b.column("key"), changed))) if last else b


class PushingReader(KvReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringStartsWith: "^"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("key",):
                self.terms.append((kinds[type(f)], f.value))
            yield f


def _filesystem(path: str):
    import pyarrow.fs as pfs

    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def register(spark: SparkSession) -> None:
    """Make the source known, and let it be given filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KvSource)
