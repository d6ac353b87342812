"""Declarative filters as Column expressions and semi-joins.

A filter is a dictionary of fields and conditions, in three-valued logic as in SQL::

    {"status": "ACTIVE", "price": {"gte": 10, "lt": 20}, "OR": [{...}, {...}], "lines": {"some": {...}}}

Fields that are relations (see Relation) take the quantifiers some, none and every for child rows, and is and
isNot for a parent row. They become left-semi and left-anti joins, which can be applied where a filter holds
them by conjunction; elsewhere they become a flag column from a left join on distinct keys. An empty OR is
false, an empty AND true; ``in`` with an empty list is false, ``notIn`` with an empty list true.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """Rows of another frame: child rows where their ``child_key`` is our ``key``, or the parent that it names."""

    frame: DataFrame
    key: str
    child_key: str
    relations: dict[str, Relation] | None = None


@dataclass(frozen=True)
class Ref:
    """The value of another column, as the operand of a comparison."""

    column: str


def _operand(value: Any) -> Column:
    return F.col(value.column) if isinstance(value, Ref) else F.lit(value)


def _text(column: Column, value: str, method: str, insensitive: bool) -> Column:
    """Literal substring tests: the operand's % and _ mean themselves."""
    operand = _operand(value)
    if insensitive:
        column, operand = F.lower(column), F.lower(operand)
    return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[method](column, operand)


def condition(column: Column, spec: Any) -> Column:
    """A field's condition: a value (null means IS NULL), or a dictionary of operators, all of which must hold."""
    if spec is None:
        return column.isNull()
    if not isinstance(spec, dict):
        return column == _operand(spec)
    insensitive = spec.get("mode") == "insensitive"
    parts = []
    for op, value in spec.items():
        if op == "mode":
            continue
        if op == "equals":
            if value is None:
                parts.append(column.isNull())
            elif insensitive:
                parts.append(F.lower(column) == F.lower(_operand(value)))
            else:
                parts.append(column == _operand(value))
        elif op == "not":
            if value is None:
                parts.append(column.isNotNull())
            else:
                parts.append(~condition(column, value) if isinstance(value, dict) else column != _operand(value))
        elif op == "in":
            parts.append(column.isin(list(value)) if value else F.lit(False))
        elif op == "notIn":
            parts.append(~column.isin(list(value)) if value else F.lit(True))
        elif op in ("lt", "lte", "gt", "gte"):
            other = _operand(value)
            parts.append({"lt": column < other, "lte": column <= other, "gt": column > other, "gte": column >= other}[op])
        elif op in ("contains", "startsWith", "endsWith"):
            parts.append(_text(column, value, op, insensitive))
        elif op == "path":
            rest = {k: v for k, v in spec.items() if k != "path"}
            return json_condition(column, value, rest)
        else:
            raise ValueError(f"unknown operator {op!r}")
    return reduce(and_, parts, F.lit(True))


def json_condition(column: Column, path: list[str | int], spec: dict) -> Column:
    """A condition on a value inside of a JSON text: string_contains and the like, comparisons, array_contains, nulls."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    value = F.get_json_object(column, f"${steps}")
    parts = []
    for op, operand in spec.items():
        if op == "equals":
            parts.append(value.isNull() & column.isNotNull() if operand == "JsonNull" else value == F.lit(str(operand)))
        elif op in ("string_contains", "string_starts_with", "string_ends_with"):
            method = {"string_contains": "contains", "string_starts_with": "startsWith", "string_ends_with": "endsWith"}[op]
            parts.append(_text(value, operand, method, False))
        elif op in ("lt", "lte", "gt", "gte"):
            parts.append(condition(value.cast("double"), {op: operand}))
        elif op == "array_contains":
            parts.append(F.arrays_overlap(F.from_json(value, "array<string>"), F.array(*[F.lit(str(x)) for x in operand])))
        elif op == "array_starts_with":
            parts.append(F.get(F.from_json(value, "array<string>"), F.lit(0)) == F.lit(str(operand)))
        elif op == "array_ends_with":
            parts.append(F.element_at(F.from_json(value, "array<string>"), -1) == F.lit(str(operand)))
        else:
            raise ValueError(f"unknown JSON operator {op!r}")
    return reduce(and_, parts, F.lit(True))


_QUANTIFIERS = ("some", "none", "every", "is", "isNot")


def _pieces(spec: dict, relations: dict[str, Relation]) -> tuple[list[Column], list[tuple[Relation, str, dict]]]:
    """Conditions on columns, and relation tests, that must all hold."""
    columns: list[Column] = []
    tests: list[tuple[Relation, str, dict]] = []
    for name, value in spec.items():
        if name == "AND":
            for part in value if isinstance(value, list) else [value]:
                more, further = _pieces(part, relations)
                columns += more
                tests += further
        elif name in relations:
            if value is None:
                tests.append((relations[name], "none", {}))
            elif not any(q in value for q in _QUANTIFIERS):
                tests.append((relations[name], "some", value))
            else:
                for q, inner in value.items():
                    tests.append((relations[name], {"is": "some", "isNot": "none"}.get(q, q), inner or {}))
        elif name not in ("OR", "NOT"):
            columns.append(condition(F.col(name), value))
    return columns, tests


def where(df: DataFrame, spec: dict | None, relations: dict[str, Relation] | None = None) -> DataFrame:
    """The rows of df that a filter holds for. Absent filters (None, {}) keep all rows."""
    spec, relations = spec or {}, relations or {}
    columns, tests = _pieces(spec, relations)
    flags: dict[str, None] = {}

    def tree(part: dict) -> Column:
        """A Boolean of a filter inside OR or NOT; its relation tests become flag columns of the frame."""
        nonlocal df
        own, inner = _pieces({k: v for k, v in part.items()}, relations)
        out = list(own)
        for relation, quantifier, child in inner:
            name = f"_flag{len(flags)}"
            flags[name] = None
            df = _flag(df, relation, quantifier, child, name)
            out.append(F.col(name))
        out += _boolean(part)
        return reduce(and_, out, F.lit(True))

    def _boolean(part: dict) -> list[Column]:
        out = []
        if "OR" in part:
            out.append(reduce(or_, [tree(p) for p in part["OR"]], F.lit(False)))
        if "NOT" in part:
            negated = part["NOT"] if isinstance(part["NOT"], list) else [part["NOT"]]
            out += [~tree(p) for p in negated]
        for p in part.get("AND", []) if isinstance(part.get("AND"), list) else [part["AND"]] if "AND" in part else []:
            out += _boolean(p)
        return out

    if columns:
        df = df.filter(reduce(and_, columns))
    for relation, quantifier, child in tests:
        df = _join(df, relation, quantifier, child)
    rest = _boolean(spec)
    if rest:
        df = df.filter(reduce(and_, rest))
    return df.drop(*flags)


def _keys(relation: Relation, quantifier: str, child: dict) -> DataFrame:
    """Distinct keys that decide: of children that fit (some, none), or of children that don't (every)."""
    inner = relation.relations or {}
    if quantifier == "every":
        marked = relation.frame.withColumn("_row", F.monotonically_increasing_id())
        fitting = where(marked, child, inner).select("_row")
        rows = marked.join(fitting, "_row", "left_anti") if inner else relation.frame.filter(~F.coalesce(_all(child), F.lit(False)))
    else:
        rows = where(relation.frame, child, inner)
    return rows.select(F.col(relation.child_key).alias("_key"))


def _all(child: dict) -> Column:
    columns, _ = _pieces(child, {})
    if "OR" in child:
        columns.append(reduce(or_, [_all(p) for p in child["OR"]], F.lit(False)))
    if "NOT" in child:
        columns += [~_all(p) for p in (child["NOT"] if isinstance(child["NOT"], list) else [child["NOT"]])]
    return reduce(and_, columns, F.lit(True))


def _join(df: DataFrame, relation: Relation, quantifier: str, child: dict) -> DataFrame:
    keys = _keys(relation, quantifier, child)
    return df.join(keys, F.col(relation.key) == F.col("_key"), "left_semi" if quantifier == "some" else "left_anti")


def _flag(df: DataFrame, relation: Relation, quantifier: str, child: dict, name: str) -> DataFrame:
    keys = _keys(relation, quantifier, child).distinct().withColumn(name, F.lit(True))
    joined = df.join(keys, F.col(relation.key) == F.col("_key"), "left").drop("_key")
    there = F.coalesce(F.col(name), F.lit(False))
    return joined.withColumn(name, there if quantifier == "some" else ~there)
