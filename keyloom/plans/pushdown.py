"""What conditions the optimizer brings to each use of a table in a query.

Each table is stood in for by a file relation that carries its name and is never read. In the optimized plan of a query,
conditions on a relation stand directly above it, whatever aliases, joins or subqueries the query has, and constants are
evaluated. They are read from there, so nothing is concluded from the text of the query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAME = "keyloom.table"
OPERATORS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
TURNED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}

Term = tuple[str, str, object]


def is_query(text: str) -> bool:
    """Whether a statement only reads; others would take effect when they are analysed."""
    return re.match(r"(?:\s|\(|--[^\n]*\n|/\*.*?\*/)*(?:SELECT|WITH|FROM|VALUES|TABLE)\b", text, re.I | re.S) is not None and not re.search(r"\bINSERT\b", text, re.I)


def stand_in(spark: SparkSession, name: str, ddl: str, path: str) -> DataFrame:
    """A relation with a table's columns."""
    return spark.read.schema(ddl).option(NAME, name).option("pathGlobFilter", "none").parquet(path)


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _terms(e) -> list[Term]:
    if _name(e) == "And":
        return _terms(e.left()) + _terms(e.right())
    if _name(e) not in OPERATORS:
        return []
    op, left, right = OPERATORS[_name(e)], e.left(), e.right()
    if _name(left) == "Literal":
        op, left, right = TURNED[op], right, left
    if _name(left) != "AttributeReference" or _name(right) != "Literal" or right.value() is None:
        return []
    kind = right.dataType().simpleString()
    value = right.value().toString() if kind == "string" else right.value() if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else None
    return [] if value is None else [(left.name(), op, value)]


def _table(node) -> str | None:
    if _name(node) != "LogicalRelation":
        return None
    options = node.relation().options()
    return options.apply(NAME) if options.contains(NAME) else None


def conditions(df: DataFrame) -> dict[str, list[list[Term]]]:
    """For each table, a list of comparisons (column, operator, constant) for each of its uses."""
    out: dict[str, list[list[Term]]] = {}

    def walk(node) -> None:
        if _name(node) == "Filter" and (name := _table(node.child())):
            out.setdefault(name, []).append(_terms(node.condition()))
        else:
            if name := _table(node):
                out.setdefault(name, []).append([])
            for child in _each(node.children()):
                walk(child)
        for inner in _each(node.subqueries()):
            walk(inner)

    walk(df._jdf.queryExecution().optimizedPlan())
    return out
