"""Column types: how stored text becomes a value and a value becomes stored text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.errors import ConfigError

#: The words read as booleans (their unique beginnings count too).
TRUE_WORDS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_WORDS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]


def _fail(kind: str, v: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"invalid input for type {kind}: "), v))


def _boolean(v: Column) -> Column:
    w = F.lower(F.trim(v))
    return F.when(v.isNull(), None).when(w.isin(TRUE_WORDS), True).when(w.isin(FALSE_WORDS), False).otherwise(_fail("boolean", v).cast("boolean"))


def _binary(v: Column) -> Column:
    digits = F.regexp_replace(v, r"^\\x", "")
    good = digits.rlike(r"^([0-9a-fA-F]{2})*$")
    return F.when(v.isNull(), None).when(good, F.unhex(digits)).otherwise(_fail("bytea: invalid hex format", v).cast("binary"))


def _cast(name: str) -> Callable[[Column], Column]:
    return lambda v: v.cast(name)


@dataclass(frozen=True)
class ColumnType:
    """A type by its Spark name. ``fixed`` values fit a hash aggregate's buffer."""

    spark: str
    read: Callable[[Column], Column]
    write: Callable[[Column], Column]
    fixed: bool = True


def _text() -> ColumnType:
    return ColumnType("string", lambda v: v, lambda c: c, fixed=False)


def _decimal(p: int, s: int) -> ColumnType:
    return ColumnType(f"decimal({p},{s})", _cast(f"decimal({p},{s})"), _cast("string"), fixed=p <= 18)


_SIMPLE = {
    "text": _text(),
    "int": ColumnType("int", _cast("int"), _cast("string")),
    "bigint": ColumnType("bigint", _cast("bigint"), _cast("string")),
    "double": ColumnType("double", _cast("double"), _cast("string")),
    "boolean": ColumnType("boolean", _boolean, lambda c: F.when(c, "t").when(~c, "f")),
    "timestamp_ntz": ColumnType("timestamp_ntz", _cast("timestamp_ntz"), _cast("string")),
    "timestamp": ColumnType("timestamp", _cast("timestamp"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")),
    "date": ColumnType("date", _cast("date"), _cast("string")),
    "variant": ColumnType("variant", F.parse_json, F.to_json, fixed=False),
    "binary": ColumnType("binary", _binary, lambda c: F.concat(F.lit("\\x"), F.lower(F.hex(c))), fixed=False),
}

#: Declared names and what they are kept as.
NAMES = {
    "text": "text",
    "string": "text",
    "varchar": "text",
    "character varying": "text",
    "char": "text",
    "character": "text",
    "bpchar": "text",
    "int": "int",
    "integer": "int",
    "int4": "int",
    "bigint": "bigint",
    "int8": "bigint",
    "long": "bigint",
    "double": "double",
    "double precision": "double",
    "float8": "double",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp_ntz": "timestamp_ntz",
    "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp",
    "date": "date",
    "jsonb": "variant",
    "json": "variant",
    "variant": "variant",
    "bytea": "binary",
    "binary": "binary",
}

_DECLARED = re.compile(r"([a-z_0-9]+(?: [a-z]+)*)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?((?: [a-z]+)*)")


def column_type(declared: str) -> ColumnType:
    """The type of a declaration such as ``VARCHAR(20)``, ``NUMERIC(10,2)`` or ``TIMESTAMP WITH TIME ZONE``."""
    m = _DECLARED.fullmatch(" ".join(declared.lower().split()))
    name = (m[1] + (m[4] or "")).strip() if m else declared
    if name in ("numeric", "decimal"):
        p, s = int(m[2] or 38), int(m[3] or (18 if m[2] is None else 0))
        return _decimal(p, s)
    if name not in NAMES:
        raise ConfigError(f"type {declared!r} is not supported", "Use TEXT, VARCHAR, INTEGER, BIGINT, DOUBLE, BOOLEAN, NUMERIC, TIMESTAMP, TIMESTAMPTZ, DATE, JSONB or BYTEA")
    return _SIMPLE[NAMES[name]]
