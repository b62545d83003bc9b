"""A table's columns, split into identity columns (named by the pattern's captures) and attribute columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from keyloom.errors import ConfigError
from keyloom.functions.pattern import KeyPattern
from keyloom.functions.types import ColumnType, column_type

_SPLIT = re.compile(r",(?![^(]*\))")
_COLUMN = re.compile(r"""\s*(?:"((?:[^"]|"")+)"|`((?:[^`]|``)+)`|(\w+))\s+(.*?)(\s+not\s+null|\s+null)?\s*""", re.I | re.S)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: ColumnType
    not_null: bool = False


def columns(ddl: str) -> list[ColumnDef]:
    """Columns of a list such as ``id TEXT NOT NULL, "group" TEXT, price NUMERIC(10,2)``."""
    out = []
    for part in _SPLIT.split(ddl):
        m = _COLUMN.fullmatch(part)
        if not m:
            raise ConfigError(f"column {part.strip()!r} cannot be read")
        name = m[1].replace('""', '"') if m[1] else m[2].replace("``", "`") if m[2] else m[3]
        out.append(ColumnDef(name, column_type(m[4]), bool(m[5]) and "not" in m[5].lower()))
    return out


class Projection:
    """Validated columns of a pivot table."""

    def __init__(self, pattern: KeyPattern, cols: list[ColumnDef]) -> None:
        self.pattern, self.columns = pattern, tuple(cols)
        self.by_name = {c.name: c for c in cols}
        identity = [c for c in cols if pattern.has_capture(c.name)]
        if len(self.by_name) != len(cols):
            twice = next(c.name for i, c in enumerate(cols) if any(d.name == c.name for d in cols[:i]))
            raise ConfigError(f"Duplicate column name: {twice}")
        if len(identity) != pattern.capture_count:
            raise ConfigError(f"Pattern has {pattern.capture_count} capture segments but projection has {len(identity)} identity columns")
        self.identity = tuple(self.by_name[n] for n in pattern.capture_names)  # in pattern order
        self.attrs = tuple(c for c in cols if not pattern.has_capture(c.name))
        if not self.attrs:
            raise ConfigError("Projection must have at least one attr column")

    def column(self, name: str) -> ColumnDef | None:
        return self.by_name.get(name)

    def is_identity(self, name: str) -> bool:
        return self.pattern.has_capture(name)
