"""Key parsing and building as Column expressions, evaluated inside Spark's generated code.

``parse`` has two forms. With one delimiter and the attribute last, the rest of the key is split once into as many parts
as there are variables. Otherwise an anchored pattern is used whose variables are atomic: each ends at the first
occurrence of the literal after it and never gives it back, which a merely reluctant group would. It is matched once:
the key is replaced by its variables with ``MARK`` between them and split at it; a key that holds the mark itself is matched
variable by variable.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.pattern import KeyPattern


MARK = "\x01"


@dataclass(frozen=True)
class Parsed:
    """Expressions over a key: whether it matches, and what its variables hold if it does."""

    valid: Column
    captures: Mapping[str, Column]
    attr: Column


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex(pattern: KeyPattern) -> str:
    """The anchored pattern equivalent to ``KeyPattern.parse``; group i holds the i-th variable."""
    out, segments = ["(?s)\\A"], pattern.segments
    for i, s in enumerate(segments):
        if not s.name:
            if i == 0 or not segments[i - 1].name:
                out.append(quoted(s.text))
        elif i + 1 == len(segments):
            out.append("(.+)")
        else:
            q = quoted(segments[i + 1].text)
            out.append(f"(?!{q})(?>(.+?){q})")
    return "".join(out) + "\\z"


def parse(pattern: KeyPattern, key: Column) -> Parsed:
    variables = [s.name for s in pattern.segments if s.name]
    delimiter = pattern.uniform_delimiter
    if delimiter is not None:
        prefix = "" if pattern.segments[0].name else pattern.literal_prefix
        rest = F.substring(key, len(prefix) + 1, 2**31 - 1) if prefix else key
        if len(variables) == 1:
            values = [rest]
            valid = rest != ""
        else:
            parts = F.split(rest, quoted(delimiter), len(variables))
            values = [parts.getItem(i) for i in range(len(variables))]
            valid = (F.size(parts) == len(variables)) & ~F.array_contains(parts, "")
        valid = key.startswith(prefix) & valid if prefix else valid
    else:
        expr, n = regex(pattern), len(variables)
        one_by_one = F.array(*(F.regexp_extract(key, expr, i + 1) for i in range(n)))
        if n == 1:
            valid, values = F.regexp_like(key, F.lit(expr)), [one_by_one.getItem(0)]
        else:
            once = F.split(F.regexp_replace(key, expr, MARK.join(f"${i + 1}" for i in range(n))), MARK)
            marked = F.when(F.regexp_like(key, F.lit(expr)), one_by_one).otherwise(F.array(F.lit("")))
            parts = F.when(F.contains(key, F.lit(MARK)), marked).otherwise(once)
            valid, values = F.size(parts) == n, [parts.getItem(i) for i in range(n)]
        if pattern.literal_prefix:
            valid = key.startswith(pattern.literal_prefix) & valid
    named = dict(zip(variables, values, strict=True))
    attr = named.pop("attr")
    return Parsed(valid, named, attr)


def build(pattern: KeyPattern, captures: Mapping[str, Column], attr: Column, strict: bool = False) -> Column:
    """The key of a row; empty or null captures are errors. ``strict`` also refuses keys that would be read back
    differently because a value holds a delimiter."""
    guarded = {}
    for name in pattern.capture_names:
        c = captures[name]
        guarded[name] = F.when(c.isNull() | (c == ""), F.raise_error(F.lit("Cannot insert row with NULL identity column")).cast("string")).otherwise(c)
    key = F.concat(*(F.lit(s.text) if not s.name else attr if s.is_attr else guarded[s.name] for s in pattern.segments))
    if strict:
        back = parse(pattern, key)
        same = back.valid & (back.attr == attr)
        for name in pattern.capture_names:
            same = same & (back.captures[name] == captures[name])
        key = F.when(same, key).otherwise(F.raise_error(F.concat(F.lit("Key would be read back differently: "), key)).cast("string"))
    return key
