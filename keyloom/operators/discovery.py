"""Schema discovery: attributes of a pattern, key prefixes, a pattern inferred from keys, and table declarations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import keyexpr
from keyloom.functions.pattern import KeyPattern

#: Delimiters looked for in keys, in order of preference.
DELIMITERS = ["##", "::", "//", "__", ":", "/", ".", "-", "_"]
#: Delimiters that end a prefix.
PREFIX_DELIMITERS = ["##", "::", "//", "__", ":", "/", ".", "-"]


def sampled(kv: DataFrame, prefix: str, max_keys: int | None) -> DataFrame:
    """The first keys under a prefix, in key order (None: all)."""
    rows = kv.where(F.col("key").startswith(prefix)) if prefix else kv
    return rows if max_keys is None else rows.orderBy("key").limit(max_keys)


def attrs(kv: DataFrame, pattern: KeyPattern, max_keys: int | None = 10_000, sample_size: int = 100, prefix_filter: str = "") -> DataFrame:
    """``(name, sample_count, sample_value)`` of each attribute among the first keys, most frequent first.

    The sample value is the first non-empty one among the attribute's first ``sample_size`` keys.
    """
    rows = sampled(kv, prefix_filter or pattern.literal_prefix, max_keys)
    if prefix_filter and pattern.literal_prefix:
        rows = rows.where(F.col("key").startswith(pattern.literal_prefix))
    p = keyexpr.parse(pattern, F.col("key"))
    hits = rows.where(p.valid).select("key", "value", p.attr.alias("name"))
    hits = hits.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("key")))
    first = F.min_by("value", F.when((F.col("value") != "") & (F.col("rn") <= sample_size), F.col("key")))
    return hits.groupBy("name").agg(F.count(F.lit(1)).alias("sample_count"), first.alias("sample_value")).orderBy(F.desc("sample_count"), "name")


def discover(kv: DataFrame, pattern: KeyPattern, max_keys: int | None = 10_000, sample_size: int = 100, prefix_filter: str = "") -> dict:
    """Attributes as a list, with the numbers of keys scanned and matched."""
    rows = sampled(kv, prefix_filter or pattern.literal_prefix, max_keys)
    p = keyexpr.parse(pattern, F.col("key"))
    hit = F.sum(F.when(p.valid, 1).otherwise(0)).cast("long")
    n = rows.agg(F.count(F.lit(1)).alias("n"), hit.alias("m")).first()
    found = [r.asDict() for r in attrs(kv, pattern, max_keys, sample_size, prefix_filter).collect()]
    return {"attrs": found, "keys_scanned": n["n"], "keys_matched": n["m"] or 0}


def list_prefixes(kv: DataFrame, depth: int = 2, max_prefixes: int = 100) -> DataFrame:
    """``(prefix)``: keys cut after their depth-th delimiter (or their last one; keys without any are whole), sorted."""
    if depth < 1:
        return kv.select(F.col("key").alias("prefix")).limit(0)
    one = "(?:.*?(?:" + "|".join(keyexpr.quoted(d) for d in PREFIX_DELIMITERS) + "))"
    head = F.regexp_extract("key", f"(?s)\\A{one}{{1,{depth}}}", 0)
    return kv.select(F.when(head == "", F.col("key")).otherwise(head).alias("prefix")).distinct().orderBy("prefix").limit(max_prefixes)


def _split(key: str, delimiter: str) -> list[str]:
    parts = key.split(delimiter)
    return parts[:-1] if parts[-1] == "" else parts


def infer_pattern_of(keys: list[str]) -> str | None:
    """A pattern for sorted sample keys: parts that never change stay literal, the last one that does is the attribute."""
    counts = [sum(k.count(d) for k in keys) for d in DELIMITERS]
    if not max(counts, default=0):
        return None
    delimiter = DELIMITERS[counts.index(max(counts))]
    parts = _split(keys[0], delimiter)
    if len(parts) < 2:
        return None
    alike = [p for p in (_split(k, delimiter) for k in keys) if len(p) == len(parts)]
    varies = [len({p[i] for p in alike}) > 1 for i in range(len(parts))]
    number, out = 0, []
    for i, part in enumerate(parts):
        if varies[i] and i == len(parts) - 1:
            out.append("{attr}")
        elif varies[i]:
            number += 1
            out.append(f"{{col{number}}}")
        else:
            out.append(part)
    return delimiter.join(out)


def infer_pattern(kv: DataFrame, sample_count: int = 100) -> str | None:
    """A pattern inferred from the first keys (a bounded sample)."""
    return infer_pattern_of([r["key"] for r in kv.select("key").orderBy("key").limit(sample_count).collect()])


def quote(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) and name not in ("group", "order", "table", "user", "select", "where", "from") else '"' + name.replace('"', '""') + '"'


def columns_of(pattern: KeyPattern, found: list[dict]) -> str:
    """A column list: identities in pattern order, then attributes by frequency, all text."""
    return ", ".join(f"{quote(n)} TEXT" for n in [*pattern.capture_names, *(a["name"] for a in found)])


def generate_ddl(table: str, server: str, pattern: KeyPattern, found: list[dict]) -> str:
    """The declaration of a foreign table for discovered attributes."""
    text = pattern.pattern.replace("'", "''")
    return f"CREATE FOREIGN TABLE {quote(table)} ({columns_of(pattern, found)}) SERVER {quote(server)} OPTIONS (key_pattern '{text}')"
