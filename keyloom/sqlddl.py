"""SQL front end for what Spark SQL has no statement for: servers, foreign tables, imports, changes, listening, EXPLAIN.

Anything else is left to Spark. Conditions, assigned expressions, VALUES and SELECT parts are Spark SQL.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.errors import ConfigError
from keyloom.operators.tables import Bounds

if TYPE_CHECKING:
    from keyloom.engine import Engine

NAME = r'(?:"(?:[^"]|"")+"|`(?:[^`]|``)+`|[\w.]+)'
OPTIONS = r"OPTIONS\s*\((?P<options>.*)\)"
STRING = r"'(?:[^']|'')*'"
_STATEMENTS: list[tuple[re.Pattern, str]] = [
    (re.compile(p + r"\s*;?\s*", re.I | re.S), f)
    for p, f in [
        (rf"CREATE\s+SERVER\s+(?P<not>IF\s+NOT\s+EXISTS\s+)?(?P<name>{NAME})(?:\s+FOREIGN\s+DATA\s+WRAPPER\s+{NAME})?\s+{OPTIONS}", "create_server"),
        (rf"DROP\s+SERVER\s+(?P<if>IF\s+EXISTS\s+)?(?P<name>{NAME})(?P<cascade>\s+CASCADE)?", "drop_server"),
        (rf"CREATE\s+FOREIGN\s+TABLE\s+(?P<not>IF\s+NOT\s+EXISTS\s+)?(?P<name>{NAME})\s*\((?P<columns>.*)\)\s*SERVER\s+(?P<server>{NAME})(?:\s+{OPTIONS})?", "create_table"),
        (rf"DROP\s+FOREIGN\s+TABLE\s+(?P<if>IF\s+EXISTS\s+)?(?P<name>{NAME})(?:\s+CASCADE)?", "drop_table"),
        (rf"IMPORT\s+FOREIGN\s+SCHEMA\s+(?P<name>{NAME})\s+FROM\s+SERVER\s+(?P<server>{NAME})\s+INTO\s+(?P<schema>{NAME})", "import_schema"),
        (rf"INSERT\s+INTO\s+(?P<name>{NAME})\s*(?:\((?P<columns>[^)]*)\)\s*)?(?P<source>(?:VALUES|SELECT|WITH|TABLE|FROM)\b.*?)", "insert"),
        (rf"UPDATE\s+(?P<name>{NAME})\s+SET\s+(?P<rest>.*?)", "update"),
        (rf"DELETE\s+FROM\s+(?P<name>{NAME})(?:\s+WHERE\s+(?P<where>.*?))?", "delete"),
        (rf"ALTER\s+SERVER\s+(?P<name>{NAME})\s+{OPTIONS}", "alter_server"),
        (rf"ALTER\s+FOREIGN\s+TABLE\s+(?P<name>{NAME})\s+{OPTIONS}", "alter_table"),
        (rf"LISTEN\s+(?P<name>{NAME})", "listen"),
        (rf"UNLISTEN\s+(?P<name>\*|{NAME})", "unlisten"),
        (r"EXPLAIN\s+(?:\((?P<how>[^)]*)\)\s*)?(?P<analyze>ANALYZE\s+)?(?P<query>(?:SELECT|WITH|FROM|TABLE)\b.*?)", "explain"),
    ]
]


def unquoted(name: str) -> str:
    if name[0] in "\"`":
        return name[1:-1].replace(name[0] * 2, name[0])
    return name.rpartition(".")[2]


def split(text: str, at: str) -> list[str]:
    """Parts of a text between separators outside of quotes and brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            raw = c == "`" or i > 0 and text[i - 1] in "rR" and not re.match(r"\w", text[i - 2 : i - 1])  # no escapes inside
            i += 1
            while i < len(text) and text[i] != c:
                i += 1 + (text[i] == "\\" and not raw)
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and (m := re.compile(at, re.I).match(text, i)):
            out.append(text[start:i])
            i = start = m.end()
            continue
        i += 1
    return [*out, text[start:]]


def options(text: str | None) -> dict[str, str]:
    out = {}
    for part in split(text, ",") if text and text.strip() else []:
        m = re.fullmatch(rf"\s*(\w+)\s+({STRING})\s*", part, re.S)
        if not m:
            raise ConfigError(f"option {part.strip()!r} cannot be read")
        out[m[1]] = m[2][1:-1].replace("''", "'")
    return out


def changes(text: str) -> list[tuple[str, str, str | None]]:
    """(ADD, SET or DROP; name; value) of each option of an ALTER statement; ADD need not be written."""
    out = []
    for part in split(text, ","):
        m = re.fullmatch(rf"\s*(?:(ADD|SET|DROP)\s+)?(\w+)(?:\s+({STRING}))?\s*", part, re.I | re.S)
        if not m or ((m[1] or "").upper() == "DROP") == (m[3] is not None):
            raise ConfigError(f"option {part.strip()!r} cannot be read")
        out.append(((m[1] or "ADD").upper(), m[2], m[3] and m[3][1:-1].replace("''", "'")))
    return out


def run(engine: Engine, text: str) -> DataFrame | None:
    """The result of one of the engine's statements, or None if it is none of them."""
    for pattern, kind in _STATEMENTS:
        if m := pattern.fullmatch(text.strip()):
            g = m.groupdict()
            name = unquoted(g["name"]) if g.get("name") else None
            if kind in ("insert", "update", "delete") and name not in engine.tables or kind == "explain" and not engine.named(g["query"]):
                continue
            return globals()[f"_{kind}"](engine, name, g)
    return None


def _said(engine: Engine, what: str, n: int | None = None) -> DataFrame:
    return engine.spark.createDataFrame([(what, n)], "status string, rows long")


def _create_server(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.create_server(name, bool(g["not"]), **options(g["options"]))
    return _said(engine, "CREATE SERVER")


def _drop_server(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.drop_server(name, bool(g["if"]), bool(g["cascade"]))
    return _said(engine, "DROP SERVER")


def _create_table(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.create_table(name, unquoted(g["server"]), g["columns"], bool(g["not"]), **options(g["options"]))
    return _said(engine, "CREATE FOREIGN TABLE")


def _drop_table(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.drop_table(name, bool(g["if"]))
    return _said(engine, "DROP FOREIGN TABLE")


def _import_schema(engine: Engine, name: str, g: dict) -> DataFrame:
    return _said(engine, engine.import_schema(unquoted(g["server"]), name, unquoted(g["schema"])))


def _insert(engine: Engine, name: str, g: dict) -> DataFrame:
    rows = engine.query(g["source"])
    t = engine.tables[name]
    every = [c.name for c in t.spec.columns] or ["key", "value"] if t.raw else [c.name for c in t.spec.projection.columns]
    names = [unquoted(c.strip()) for c in g["columns"].split(",")] if g["columns"] else every[: len(rows.columns)]
    if len(names) != len(rows.columns):
        raise ConfigError(f"INSERT has {len(rows.columns)} expressions for {len(names)} columns")
    if bad := next((n for n in names if n not in every), None):
        raise ConfigError(f"unknown column {bad!r}")
    kinds = {} if t.raw else {c.name: c.type.spark for c in t.spec.projection.columns}
    rows = rows.toDF(*names)
    rows = rows.select(*(F.col(f"`{n}`").cast(kinds.get(n, "string")).alias(n) if kinds.get(n) not in ("variant", "binary") else F.col(f"`{n}`") for n in names))
    return _said(engine, "INSERT", engine.insert(name, rows))


def _update(engine: Engine, name: str, g: dict) -> DataFrame:
    new, (given, *where) = {}, split(g["rest"], r"\bWHERE\b")
    for part in split(given, ","):
        col, _, value = part.partition("=")
        new[unquoted(col.strip())] = F.expr(value.strip())
    return _said(engine, "UPDATE", engine.update(name, new, _condition(engine, where[0] if where else None)))


def _delete(engine: Engine, name: str, g: dict) -> DataFrame:
    return _said(engine, "DELETE", engine.delete(name, _condition(engine, g["where"])))


def _condition(engine: Engine, where: str | None) -> str | None:
    """The condition, with views made for tables that it names in subqueries."""
    if where and re.search(r"\bSELECT\b", where, re.I):
        for name in engine.tables:
            if re.search(rf"\b{re.escape(name)}\b", where, re.I):
                engine.table(name).createOrReplaceTempView(name)
    return where


def _alter_server(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.alter_server(name, changes(g["options"]))
    return _said(engine, "ALTER SERVER")


def _alter_table(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.alter_table(name, changes(g["options"]))
    return _said(engine, "ALTER FOREIGN TABLE")


def _listen(engine: Engine, name: str, g: dict) -> DataFrame:
    """Messages of the channel are held until ``Engine.notifications`` takes them."""
    engine.listen(name)
    return _said(engine, "LISTEN")


def _unlisten(engine: Engine, name: str, g: dict) -> DataFrame:
    engine.unlisten(name)
    return _said(engine, "UNLISTEN")


def _explain(engine: Engine, name: None, g: dict) -> DataFrame:
    """What narrows the scan of each use of a table, with ANALYZE its counters, and Spark's plan of the whole query."""
    analyze = bool(g["analyze"]) or "analyze" in (g["how"] or "").lower()
    lines = []
    for table, uses in engine.conditions(g["query"]).items():
        t = engine.tables[table]
        for terms in uses:
            if t.raw:
                where = Bounds.of([(op, v) for c, op, v in terms if c == "key" and isinstance(v, str)])
            else:
                where = {c: v for c, op, v in terms if op == "=" and t.spec.projection.is_identity(c)}
            lines += [f"Foreign Scan on {table}", *(f"  {x}" for x in engine.explain(table, where, analyze).split("\n") if x)]
    plan = engine.spark._jvm.PythonSQLUtils.explainString(engine.query(g["query"])._jdf.queryExecution(), "simple")
    return engine.spark.createDataFrame([(x,) for x in [*lines, *plan.rstrip().split("\n")]], "plan string")
