"""Pivot and raw tables over a DataFrame of ``(key, value)``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyloom.errors import ConfigError
from keyloom.functions import keyexpr
from keyloom.functions.pattern import KeyPattern
from keyloom.plans.projection import ColumnDef, Projection

#: Names of working columns, which no table column can have.
ID, ATTR = "__id_", "__attr"


def parsed(kv: DataFrame, pattern: KeyPattern, prefix: str | None = None) -> DataFrame:
    """``(key, value, __id_0.., __attr)`` of the entries whose keys match; the prefix filter reaches the file scan."""
    p = keyexpr.parse(pattern, F.col("key"))
    prefix = pattern.literal_prefix if prefix is None else prefix
    rows = kv.where(F.col("key").startswith(prefix)) if prefix else kv
    ids = [p.captures[n].alias(f"{ID}{i}") for i, n in enumerate(pattern.capture_names)]
    return rows.where(p.valid).select("key", "value", *ids, p.attr.alias(ATTR))


def ids(pattern: KeyPattern) -> list[str]:
    return [f"{ID}{i}" for i in range(pattern.capture_count)]


def text_of(value) -> str:
    """A Python constant as the text a key holds."""
    return ("t" if value else "f") if isinstance(value, bool) else str(value)


@dataclass
class PivotTable:
    """Entries that share their captures are one row; the attribute picks the column, a missing entry is NULL."""

    name: str
    pattern: KeyPattern
    projection: Projection
    prefix_filter: str | None = None

    @classmethod
    def of(cls, name: str, pattern: str, cols: list[ColumnDef], prefix_filter: str | None = None) -> PivotTable:
        p = KeyPattern(pattern)
        return cls(name, p, Projection(p, cols), prefix_filter)

    def scan_prefix(self, where: Mapping[str, object] | None = None) -> str:
        """The longest prefix known: leading text captures that are given extend the literal one."""
        known = {k: text_of(v) for k, v in (where or {}).items() if self.projection.is_identity(k) and self.projection.by_name[k].type.spark == "string" and v is not None}
        return self.pattern.build_prefix(self.pattern.leading(known))

    def entries(self, kv: DataFrame, where: Mapping[str, object] | None = None) -> DataFrame:
        rows = parsed(kv, self.pattern, self.scan_prefix(where))
        return rows.where(F.col("key").startswith(self.prefix_filter)) if self.prefix_filter else rows

    def scan(self, kv: DataFrame, where: Mapping[str, object] | None = None, raw_ids: bool = False) -> DataFrame:
        """The table's rows. ``where`` maps columns to constants they must equal; ``raw_ids`` adds the stored texts of
        the identity. Values of fixed size are typed before they are aggregated, so that a hash aggregate can hold them.
        """
        rows = self.entries(kv, where)
        for k, v in (where or {}).items():
            if self.projection.is_identity(k):
                i = self.pattern.capture_index(k)
                rows = rows.where(self.projection.by_name[k].type.read(F.col(f"{ID}{i}")) == F.lit(v))
        keys = ids(self.pattern)
        early = [c for c in self.projection.attrs if c.type.fixed]
        aggs = []
        for i, c in enumerate(self.projection.attrs):
            cell = F.when(F.col(ATTR) == c.name, F.col("value"))
            aggs.append(F.max(c.type.read(cell) if c in early else cell).alias(f"__c{i}"))
        grouped = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0")
        out = {c.name: c.type.read(F.col(f"{ID}{i}")) for i, c in enumerate(self.projection.identity)}
        for i, c in enumerate(self.projection.attrs):
            out[c.name] = F.col(f"__c{i}") if c in early else c.type.read(F.col(f"__c{i}"))
        df = grouped.select(*keys, *(out[c.name].alias(c.name) for c in self.projection.columns)) if raw_ids else grouped.select(*(out[c.name].alias(c.name) for c in self.projection.columns))
        for k, v in (where or {}).items():
            if k not in self.projection.by_name:
                raise ConfigError(f"unknown column {k!r}")
            if not self.projection.is_identity(k):
                df = df.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)) if v is None else F.col(f"`{k}`") == F.lit(v))
        return df

    def sparse(self, kv: DataFrame) -> DataFrame:
        """Identity texts and all attributes, declared or not, as a map."""
        attrs = F.map_from_entries(F.collect_list(F.struct(ATTR, "value"))).alias("attrs")
        keys = ids(self.pattern)
        rows = self.entries(kv)
        out = rows.groupBy(*keys).agg(attrs) if keys else rows.agg(attrs).where(F.size("attrs") > 0)
        return out.select(*(F.col(k).alias(n) for k, n in zip(keys, self.pattern.capture_names, strict=True)), "attrs")

    def encode(self, rows: DataFrame, strict: bool = False) -> DataFrame:
        """The entries of typed rows: one for each attribute that is not NULL."""
        captures = {c.name: c.type.write(F.col(f"`{c.name}`")) for c in self.projection.identity}
        cells = F.array(*(F.struct(F.lit(c.name).alias("attr"), c.type.write(F.col(f"`{c.name}`")).alias("value")) for c in self.projection.attrs))
        named = rows.select(*(captures[n].alias(f"{ID}{i}") for i, n in enumerate(self.pattern.capture_names)), F.explode(cells).alias("cell")).where("cell.value is not null")
        key = keyexpr.build(self.pattern, {n: F.col(f"{ID}{i}") for i, n in enumerate(self.pattern.capture_names)}, F.col("cell.attr"), strict)
        return named.select(key.alias("key"), F.col("cell.value").alias("value"))

    def counters(self, kv: DataFrame, where: Mapping[str, object] | None = None) -> dict[str, int]:
        """Run the scan and count keys scanned (within the prefix), keys skipped (no match) and rows returned."""
        seen, fit, out = Observation(), Observation(), Observation()
        prefix = self.scan_prefix(where)
        p = keyexpr.parse(self.pattern, F.col("key"))
        ranged = kv.where(F.col("key").startswith(prefix)) if prefix else kv
        ranged = ranged.observe(seen, F.count(F.lit(1)).alias("n"))
        rows = ranged.where(p.valid).observe(fit, F.count(F.lit(1)).alias("n")).select("key", "value")
        self.scan(rows, where).observe(out, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        scanned, matched = seen.get["n"], fit.get["n"]
        return {"keys_scanned": scanned, "keys_skipped": scanned - matched, "rows_returned": out.get["n"]}

    def explain(self, kv: DataFrame, where: Mapping[str, object] | None = None, analyze: bool = False) -> str:
        lines = []
        pushed = [f"{k}='{text_of(v)}'" for k, v in (where or {}).items() if self.projection.is_identity(k) and v is not None]
        if pushed:
            lines.append("Prefix Filter: " + ", ".join(pushed))
        if analyze:
            c = self.counters(kv, where)
            lines += [f"Keys Scanned: {c['keys_scanned']}", f"Keys Skipped: {c['keys_skipped']}", f"Rows Returned: {c['rows_returned']}"]
        return "\n".join(lines)


@dataclass
class Bounds:
    """A range of keys, one key, or (``nothing``) none at all."""

    exact: str | None = None
    lower: str | None = None
    upper: str | None = None
    lower_inclusive: bool = True
    upper_inclusive: bool = False
    nothing: bool = False

    OPERATORS = ("=", "<", "<=", ">", ">=")

    @classmethod
    def of(cls, clauses: list[tuple[str, str]]) -> Bounds:
        """Bounds of ``(operator, constant)`` clauses that all hold."""
        b = cls()
        for op, v in clauses:
            if op not in cls.OPERATORS:
                raise ConfigError(f"operator {op!r} does not bound keys")
            if op == "=":
                b.nothing = b.nothing or b.exact not in (None, v)
                b.exact = v
            elif op[0] == ">":
                if b.lower is None or v > b.lower or v == b.lower and op == ">":
                    b.lower, b.lower_inclusive = v, op == ">="
            elif b.upper is None or v < b.upper or v == b.upper and op == "<":
                b.upper, b.upper_inclusive = v, op == "<="
        return b

    @property
    def is_exact(self) -> bool:
        return self.exact is not None

    @property
    def is_unbounded(self) -> bool:
        return self.exact is None and self.lower is None and self.upper is None

    def condition(self, key: Column) -> Column:
        """The bounds as plain comparisons, which reach the file scan."""
        out = F.lit(not self.nothing)
        if self.exact is not None:
            out = out & (key == self.exact)
        if self.lower is not None:
            out = out & (key >= self.lower if self.lower_inclusive else key > self.lower)
        if self.upper is not None:
            out = out & (key <= self.upper if self.upper_inclusive else key < self.upper)
        return out

    def text(self) -> str:
        if self.nothing:
            return "none"
        if self.exact is not None:
            return f"key='{self.exact}'"
        said = [f"key>{'=' * self.lower_inclusive}'{self.lower}'"] if self.lower is not None else []
        return ", ".join(said + ([f"key<{'=' * self.upper_inclusive}'{self.upper}'"] if self.upper is not None else []))


@dataclass
class RawTable:
    """The entries themselves. Columns named key and value are filled, others are NULL; all must be text."""

    name: str
    columns: list[ColumnDef] = field(default_factory=list)
    prefix_filter: str | None = None

    def __post_init__(self) -> None:
        if bad := next((c for c in self.columns if c.type.spark != "string"), None):
            raise ConfigError(f"column {bad.name!r} of a raw table must be TEXT")

    def scan(self, kv: DataFrame, bounds: Bounds | None = None) -> DataFrame:
        rows = kv.where(F.col("key").startswith(self.prefix_filter)) if self.prefix_filter else kv
        if bounds and not bounds.is_unbounded:
            rows = rows.where(bounds.condition(F.col("key")))
        names = [c.name for c in self.columns] or ["key", "value"]
        return rows.select(*(F.col(n) if n in ("key", "value") else F.lit(None).cast("string").alias(n) for n in names))

    def counters(self, kv: DataFrame, bounds: Bounds | None = None) -> dict[str, int]:
        return {"keys_scanned": self.scan(kv, bounds).count()}

    def explain(self, kv: DataFrame, bounds: Bounds | None = None, analyze: bool = False) -> str:
        lines = [f"Key Bounds: {bounds.text()}"] if bounds and not bounds.is_unbounded else []
        if analyze:
            lines.append(f"Keys Scanned: {self.counters(kv, bounds)['keys_scanned']}")
        return "\n".join(lines)
