"""The engine: servers (stores), pivot and raw tables on them, statements that change them, and SQL over all of it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.errors import ConfigError, ConflictError, InvalidOptionName, InvalidOptionValue, KvError, MissingOption, PatternError, StoreError, TypeConversionError
from keyloom.functions.pattern import KeyPattern
from keyloom.operators import discovery, dml
from keyloom.operators.tables import Bounds, PivotTable, RawTable
from keyloom.plans import pushdown
from keyloom.plans.projection import ColumnDef, columns
from keyloom.sources.store import KvStore, State
from keyloom.streaming.notify import Notifier, channel_name

#: Option names and the words booleans are written with.
SERVER_OPTIONS = ["db_path", "read_only", "create_if_missing", "block_cache_size", "write_buffer_size", "use_write_batch"]
TABLE_OPTIONS = ["key_pattern", "prefix_filter", "table_mode"]
TRUE, FALSE = ["true", "on", "1", "yes"], ["false", "off", "0", "no"]
#: Prefix of working columns that hold new values.
SET = "__set_"
#: How often a statement is run again that another writer has overtaken.
TRIES = 10
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def _flag(name: str, value) -> bool:
    v = str(value).lower()
    if v not in TRUE + FALSE:
        raise InvalidOptionValue(f'invalid value for {name}: "{value}"', "Use 'true' or 'false'")
    return v in TRUE


def _size(name: str, value) -> int:
    m = re.fullmatch(r"(\d+)([kmg]?)b?", str(value).lower())
    if not m or int(m[1]) == 0:
        raise InvalidOptionValue(f'invalid value for {name}: "{value}"', "Use a positive integer, optionally with K/M/G suffix")
    return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class ServerOptions:
    db_path: str
    read_only: bool = True
    create_if_missing: bool = False
    block_cache_size: int = 8 << 20
    write_buffer_size: int = 4 << 20
    use_write_batch: bool = True

    @classmethod
    def of(cls, options: Mapping[str, object]) -> ServerOptions:
        for name in options:
            if name not in SERVER_OPTIONS:
                raise InvalidOptionName(f'invalid option "{name}" for SERVER', f"Valid options are: {', '.join(SERVER_OPTIONS)}")
        if "db_path" not in options:
            raise MissingOption('required option "db_path" not specified')
        if not options["db_path"]:
            raise InvalidOptionValue("db_path cannot be empty")
        read = {"db_path": str, "read_only": _flag, "create_if_missing": _flag, "block_cache_size": _size, "write_buffer_size": _size, "use_write_batch": _flag}
        return cls(**{k: str(v) if k == "db_path" else read[k](k, v) for k, v in options.items()})


def check_table_options(options: Mapping[str, object]) -> str:
    """Validate a table's options; returns its mode."""
    for name, value in options.items():
        if name not in TABLE_OPTIONS:
            raise InvalidOptionName(f'invalid option "{name}" for FOREIGN TABLE', f"Valid options are: {', '.join(TABLE_OPTIONS)}")
        if name == "key_pattern":
            try:
                KeyPattern(str(value))
            except PatternError as e:
                if "must contain {attr}" in str(e):
                    raise InvalidOptionValue("key_pattern must contain {attr} segment", "Example: 'users##{group}##{id}##{attr}'") from e
                raise InvalidOptionValue(f"invalid key_pattern: {e}") from e
        if name == "table_mode" and value not in ("raw", "pivot"):
            raise InvalidOptionValue(f'invalid value for table_mode: "{value}"', "Valid values are 'raw' or 'pivot'")
    mode = str(options.get("table_mode", "pivot"))
    if mode == "raw" and "key_pattern" in options:
        raise InvalidOptionName("key_pattern is not allowed for raw table mode", "Raw tables use key/value columns directly without pivoting")
    if mode == "pivot" and "key_pattern" not in options:
        raise MissingOption('required option "key_pattern" not specified', "Use key_pattern for pivot mode, or set table_mode='raw' for raw access")
    return mode


@dataclass
class Server:
    name: str
    options: ServerOptions
    given: set[str] = field(default_factory=set)
    _store: KvStore | None = field(default=None, repr=False)

    def store(self, spark: SparkSession) -> KvStore:
        if self._store is None:
            o = self.options
            self._store = KvStore(spark, o.db_path, o.create_if_missing, o.read_only)
        return self._store


@dataclass
class Table:
    name: str
    schema: str
    server: Server
    spec: PivotTable | RawTable
    options: dict[str, str] = field(default_factory=dict)

    @property
    def raw(self) -> bool:
        return isinstance(self.spec, RawTable)


def altered(options: Mapping[str, object], changes: list[tuple[str, str, str | None]]) -> dict[str, object]:
    """Options after (ADD, SET or DROP; name; value) in turn."""
    out = dict(options)
    for how, name, value in changes:
        if how == "ADD" and name in out:
            raise InvalidOptionName(f'option "{name}" provided more than once')
        if how != "ADD" and name not in out:
            raise InvalidOptionName(f'option "{name}" not found')
        if how == "DROP":
            del out[name]
        else:
            out[name] = value
    return out


@contextmanager
def typed_errors() -> Iterator[None]:
    """Text that is no value of its column's type as an error of its own class."""
    try:
        yield
    except KvError:
        raise
    except Exception as e:
        if re.search(r"CAST_INVALID_INPUT|MALFORMED_RECORD_IN_PARSING|invalid input for type|CANNOT_PARSE", str(e)):
            raise TypeConversionError(str(e).split("\n")[0]) from e
        raise


Condition = Column | str | Mapping[str, object] | None


class Engine:
    """Servers, tables and statements in one Spark session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.servers: dict[str, Server] = {}
        self.tables: dict[str, Table] = {}
        self.notifier = Notifier(spark)
        self._heard: list[str] = []

    # servers and tables

    def create_server(self, name: str, if_not_exists: bool = False, **options) -> Server:
        if name in self.servers:
            if if_not_exists:
                return self.servers[name]
            raise ConfigError(f'server "{name}" already exists')
        self.servers[name] = Server(name, ServerOptions.of(options), set(options))
        return self.servers[name]

    def drop_server(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        if name not in self.servers:
            if if_exists:
                return
            raise ConfigError(f'server "{name}" does not exist')
        used = [t for t in self.tables.values() if t.server.name == name]
        if used and not cascade:
            raise ConfigError(f'cannot drop server "{name}" because tables depend on it', "Use CASCADE to drop them too")
        for t in used:
            self.drop_table(t.name)
        del self.servers[name]

    def create_table(self, name: str, server: str, cols: str | list[ColumnDef], if_not_exists: bool = False, schema: str = "public", **options) -> Table:
        if name in self.tables:
            if if_not_exists:
                return self.tables[name]
            raise ConfigError(f'table "{name}" already exists')
        if server not in self.servers:
            raise ConfigError(f'server "{server}" does not exist')
        cols = columns(cols) if isinstance(cols, str) else cols
        self.tables[name] = Table(name, schema, self.servers[server], self._spec(name, cols, options), dict(options))
        return self.tables[name]

    @staticmethod
    def _spec(name: str, cols: list[ColumnDef], options: Mapping[str, object]) -> PivotTable | RawTable:
        mode = check_table_options(options)
        prefix = options.get("prefix_filter")
        return RawTable(name, cols, prefix) if mode == "raw" else PivotTable.of(name, str(options["key_pattern"]), cols, prefix)

    def alter_server(self, name: str, changes: list[tuple[str, str, str | None]]) -> None:
        """Change options of a server by (ADD, SET or DROP; name; value); its tables use them from now on."""
        if name not in self.servers:
            raise ConfigError(f'server "{name}" does not exist')
        server = self.servers[name]
        server.options = ServerOptions.of(altered({k: v for k, v in asdict(server.options).items() if k in server.given}, changes))
        server.given = set(altered(dict.fromkeys(server.given, ""), changes))
        server._store = None

    def alter_table(self, name: str, changes: list[tuple[str, str, str | None]]) -> None:
        """Change options of a table by (ADD, SET or DROP; name; value)."""
        t = self._table(name)
        options = altered(t.options, changes)
        cols = t.spec.columns if t.raw else t.spec.projection.columns
        t.spec, t.options = self._spec(name, cols, options), options

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables:
            if if_exists:
                return
            raise ConfigError(f'table "{name}" does not exist')
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise ConfigError(f'table "{name}" does not exist')
        return self.tables[name]

    def kv(self, name: str) -> DataFrame:
        """The current entries of a table's server."""
        return self._table(name).server.store(self.spark).read()

    # reading

    def table(self, name: str, where: Mapping[str, object] | Bounds | None = None) -> DataFrame:
        """A table's rows; constants or key bounds given here narrow the scan itself."""
        return self._table(name).spec.scan(self.kv(name), where)

    def sql(self, text: str) -> DataFrame:
        """Run a statement; the engine's own statements are handled here, all others by Spark over views of the tables."""
        from keyloom import sqlddl

        handled = sqlddl.run(self, text)
        return handled if handled is not None else self.query(text)

    def named(self, text: str) -> list[str]:
        """Tables that a statement may name."""
        return [n for n in self.tables if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.I)]

    def query(self, text: str) -> DataFrame:
        """Spark SQL over views of the tables it names.

        The optimizer is asked first what conditions reach each table, over stand-ins that are never read. Where all
        uses of a table fix leading text captures or bound the key, its scan is narrowed to their prefixes or ranges; the
        statement checks its conditions again. The views under the tables' names are whole again once it is analysed.
        """
        names = self.named(text)
        if not names:
            return self.spark.sql(text)
        found = self.conditions(text, names) if pushdown.is_query(text) else {}
        for n in names:
            self.narrowed(n, found.get(n, [])).createOrReplaceTempView(n)
        try:
            return self.spark.sql(text)
        finally:
            for n in names:
                self.table(n).createOrReplaceTempView(n)

    def conditions(self, text: str, names: list[str] | None = None) -> dict[str, list[list[tuple[str, str, object]]]]:
        """For each use of a table in a query, the comparisons (column, operator, constant) that its rows must meet."""
        names = self.named(text) if names is None else names
        for n in names:
            t = self._table(n)
            cols = [f"`{c.name}` {c.type.spark}" for c in (t.spec.columns or columns("key TEXT, value TEXT") if t.raw else t.spec.projection.columns)]
            store = t.server.store(self.spark)
            pushdown.stand_in(self.spark, n, ", ".join(cols), f"{store.path}/{store.current()[0]}").createOrReplaceTempView(n)
        try:
            return pushdown.conditions(self.spark.sql(text))
        finally:
            for n in names:
                self.table(n).createOrReplaceTempView(n)

    def narrowed(self, name: str, uses: list[list[tuple[str, str, object]]]) -> DataFrame:
        """A table's scan over the entries that its uses can have."""
        t, kv = self._table(name), self.kv(name)
        key, tests = F.col("key"), []
        for terms in uses:
            if t.raw:
                bounds = Bounds.of([(op, v) for c, op, v in terms if c == "key" and op in Bounds.OPERATORS and isinstance(v, str)])
                test = None if bounds.is_unbounded else bounds.condition(key)
            else:
                prefix = t.spec.scan_prefix({c: v for c, op, v in terms if op == "=" and isinstance(v, str)})
                test = key.startswith(prefix) if prefix != t.spec.scan_prefix() else None
            if test is None:
                return self.table(name)
            tests.append(test)
        return t.spec.scan(kv.where(reduce(or_, tests)) if tests else kv)

    def explain(self, name: str, where: Mapping[str, object] | Bounds | None = None, analyze: bool = False) -> str:
        return self._table(name).spec.explain(self.kv(name), where, analyze)

    def counters(self, name: str, where: Mapping[str, object] | Bounds | None = None) -> dict[str, int]:
        return self._table(name).spec.counters(self.kv(name), where)

    # changing

    def _writable(self, name: str) -> tuple[Table, KvStore]:
        t = self._table(name)
        if t.server.options.read_only:
            raise StoreError("Cannot create writer for read-only connection")
        return t, t.server.store(self.spark)

    def _old(self, t: Table, kv: DataFrame, where: Condition) -> DataFrame:
        constants = where if isinstance(where, Mapping) else None
        rows = t.spec.scan(kv) if t.raw else t.spec.scan(kv, constants, raw_ids=True)
        if t.raw and constants:
            for k, v in constants.items():
                rows = rows.where(F.col(k) == F.lit(v))
        if isinstance(where, str):
            rows = rows.where(F.expr(where))
        elif isinstance(where, Column):
            rows = rows.where(where)
        return rows

    @contextmanager
    def _once(self, store: KvStore, rows: DataFrame) -> Iterator[tuple[DataFrame, int]]:
        """The rows of a statement, evaluated once and in a fixed order, and their number."""
        if rows._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation":
            yield dml.ordered(rows), rows.count()
            return
        at = f"{store.path}/_staged/{uuid.uuid4().hex}"
        dml.ordered(rows).write.parquet(at)
        try:
            staged = self.spark.read.parquet(at)
            yield staged, staged.count()
        finally:
            store._fs.delete(store._at(f"_staged/{at.rpartition('/')[2]}"), True)

    def _commit(self, t: Table, store: KvStore, ops: DataFrame, touched: int, based_on: State | None = None) -> int:
        """One delta and one message for a statement that touched a row; nothing for others."""
        if touched:
            if t.server.options.use_write_batch:
                store.apply(ops, based_on)
            else:  # operations are visible as they are written
                store.apply(ops.where(F.col("phase") == dml.DEL), based_on)
                store.apply(ops.where(F.col("phase") == dml.PUT))
            self.notifier.notify(channel_name(t.schema, t.name), f"{store.path}/_changes", store.version)
        return touched

    def _again(self, statement: Callable[[], int]) -> int:
        """Run a statement that reads what it changes, again if another writer was faster."""
        for n in range(TRIES):
            try:
                with typed_errors():
                    return statement()
            except ConflictError:
                if n + 1 == TRIES:
                    raise
        raise AssertionError

    def insert(self, name: str, rows: DataFrame | list[Mapping[str, object]], strict: bool = False) -> int:
        """Insert (or merge into) rows; returns their number."""
        t, store = self._writable(name)
        make = dml.raw_put_ops if t.raw else lambda r: dml.insert_ops(t.spec, r, strict)
        with typed_errors():
            if isinstance(rows, list):
                return self._commit(t, store, make(self._frame(t, rows)), len(rows))
            with self._once(store, rows) as (staged, n):
                return self._commit(t, store, make(staged), n)

    def _frame(self, t: Table, rows: list[Mapping[str, object]]) -> DataFrame:
        cols = t.spec.columns or columns("key TEXT, value TEXT") if t.raw else t.spec.projection.columns
        given = [c for c in cols if any(c.name in r for r in rows)]
        schema = ", ".join(f"`{c.name}` {c.type.spark}" for c in given)
        data = [(i, *(r.get(c.name) for c in given)) for i, r in enumerate(rows)]
        return self.spark.createDataFrame(data, f"ord long, {schema}")

    def update(self, name: str, changes: Mapping[str, Column | str | int | float | None], where: Condition = None, strict: bool = False) -> int:
        """Set columns (to expressions over the old row, or constants) of the rows that match; returns their number."""
        t, store = self._writable(name)
        new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()}
        kinds = {"key": "string", "value": "string"} if t.raw else {c.name: c.type.spark for c in t.spec.projection.columns}
        if bad := next((k for k in new if k not in kinds), None):
            raise ConfigError(f"unknown column {bad!r}")

        def run() -> int:
            state = store.state()
            kv = store.read(state)
            old = self._old(t, kv, where)
            old = old.select("*", *(v.cast(kinds[k]).alias(f"{SET}{k}") for k, v in new.items()))
            with self._once(store, old) as (rows, n):
                given = {k: F.col(f"`{SET}{k}`") for k in new}
                ops = dml.raw_update_ops(rows, given.get("value")) if t.raw else dml.update_ops(t.spec, kv, rows, given, strict)
                return self._commit(t, store, ops, n, state)

        return self._again(run)

    def delete(self, name: str, where: Condition = None) -> int:
        """Delete the rows that match, with all attributes stored for them; returns their number."""
        t, store = self._writable(name)

        def run() -> int:
            state = store.state()
            kv = store.read(state)
            with self._once(store, self._old(t, kv, where)) as (rows, n):
                ops = dml.raw_delete_ops(rows) if t.raw else dml.delete_ops(t.spec, kv, rows)
                return self._commit(t, store, ops, n, state)

        return self._again(run)

    def compact(self, server: str) -> None:
        """Merge a store's deltas into a new snapshot; to be called between statements, by whoever keeps the store."""
        self.servers[server].store(self.spark).compact()

    # discovery and notification

    def import_schema(self, server: str, table: str, schema: str = "public") -> str:
        """Infer a pattern and its attributes from a server's first keys and create a table; returns its declaration."""
        if server not in self.servers:
            raise ConfigError(f'server "{server}" does not exist')
        kv = self.servers[server].store(self.spark).read()
        text = discovery.infer_pattern(kv, 1000)
        if text is None:
            raise KvError("no key pattern could be inferred")
        pattern = KeyPattern(text)
        found = discovery.discover(kv, pattern)["attrs"]
        self.create_table(table, server, discovery.columns_of(pattern, found), schema=schema, key_pattern=text)
        return discovery.generate_ddl(table, server, pattern, found)

    def listen(self, channel: str, fn: Callable[[str], None] | None = None) -> None:
        """Call ``fn`` with the channel at each message; without it, messages are held for ``notifications``."""
        self.notifier.listen(channel, fn or self._heard.append)

    def notifications(self) -> list[str]:
        """The channels of the messages held since the last call, oldest first."""
        out = list(self._heard)
        self._heard.clear()
        return out

    def unlisten(self, channel: str, fn: Callable[[str], None] | None = None) -> None:
        self.notifier.unlisten(channel, fn)
