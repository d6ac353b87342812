"""Reading rows: projection, order, paging, distinct, counts, aggregates and groups, on frames.

Order follows the catalogue's database: ascending puts nulls last, descending puts them first, unless an order
says otherwise; enumerations sort by the order in which their values are declared.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.where import Relation, where


def order_columns(order_by: dict | list[dict], enums: dict[str, list[str]] | None = None, reverse: bool = False) -> list[Column]:
    """Sort columns of [{field: "asc" | "desc" | {"sort": ..., "nulls": "first" | "last"}}, ...]."""
    out = []
    for part in order_by if isinstance(order_by, list) else [order_by]:
        for name, spec in part.items():
            sort, nulls = (spec["sort"], spec.get("nulls")) if isinstance(spec, dict) else (spec, None)
            down = (sort == "desc") != reverse
            first = (nulls == "first") if nulls else sort == "desc"
            first = first != reverse
            column = F.col(name)
            if name in (enums or {}):
                column = F.array_position(F.array(*[F.lit(v) for v in enums[name]]), column)
            if down:
                out.append(column.desc_nulls_first() if first else column.desc_nulls_last())
            else:
                out.append(column.asc_nulls_first() if first else column.asc_nulls_last())
    return out


def find_many(
    df: DataFrame,
    where_: dict | None = None,
    select: list[str] | None = None,
    omit: list[str] | None = None,
    order_by: dict | list[dict] | None = None,
    skip: int | None = None,
    take: int | None = None,
    distinct: list[str] | None = None,
    cursor: dict[str, Any] | None = None,
    relations: dict[str, Relation] | None = None,
    enums: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Rows by filter, order and page. A negative take counts from the end, in the same order.

    A cursor is the sort key of the row where the page begins (that row included): keyset paging, which needs
    no offset and prunes by predicate. ``distinct`` keeps the first row of each combination in the order.
    """
    out = where(df, where_, relations)
    backwards = take is not None and take < 0
    order = order_columns(order_by or [], enums)
    if distinct:
        first = Window.partitionBy(*distinct).orderBy(*(order or [F.lit(0)]))
        out = out.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    if cursor:
        out = out.filter(_from_cursor(cursor, order_by, backwards))
    if order:
        out = out.orderBy(*order_columns(order_by, enums, reverse=backwards))
    if skip:
        out = out.offset(skip)
    if take is not None:
        out = out.limit(abs(take))
        if backwards and order:
            out = out.orderBy(*order)
    if select:
        out = out.select(*select)
    return out.drop(*omit) if omit else out


def _from_cursor(cursor: dict[str, Any], order_by: dict | list[dict], backwards: bool) -> Column:
    parts = [(n, s) for p in (order_by if isinstance(order_by, list) else [order_by]) for n, s in p.items()]
    keep = F.lit(True)
    for name, sort in reversed(parts):
        down = ((sort["sort"] if isinstance(sort, dict) else sort) == "desc") != backwards
        column, value = F.col(name), F.lit(cursor[name])
        keep = (column < value if down else column > value) | ((column == value) & keep)
    return keep


def parameter(value: str | list[str] | None) -> str | None:
    """A request's parameter: the first of several, without blanks around it; None if nothing is left."""
    first = (value[0] if value else None) if isinstance(value, list) else value
    return (first or "").strip() or None


def page_number(value: str | list[str] | None) -> int:
    """The page a request asks for: digits alone, 1 to 2^53 - 1; else 1."""
    raw = parameter(value)
    number = int(raw) if raw and raw.isascii() and raw.isdigit() and len(raw) < 20 else 1
    return number if 0 < number < 1 << 53 else 1


def optional_filter(always: dict, parameters: dict[str, Any], builders: dict[str, Callable[[str], dict]]) -> dict:
    """A filter for where(): what always holds, and what the builder of each parameter that isn't blank adds."""
    given = {name: parameter(parameters.get(name)) for name in builders}
    return {"AND": [always, *[builders[name](value) for name, value in given.items() if value]]}


def find_first(df: DataFrame, where_: dict | None = None, order_by: dict | list[dict] | None = None, **more: Any) -> DataFrame:
    return find_many(df, where_, order_by=order_by, take=1, **more)


def find_unique(df: DataFrame, key: dict[str, Any], or_throw: bool = False) -> DataFrame:
    """At most one row; with or_throw an error when the row is read and there is none."""
    row = where(df, key).limit(1)
    if not or_throw:
        return row
    there = row.agg(F.count("*").alias("_n")).filter(F.assert_true(F.col("_n") > 0, "no such row").isNull())
    return there.join(row, how="left").drop("_n")


def page(df: DataFrame, order_by: list[dict], number: int, size: int) -> tuple[DataFrame, int, int]:
    """A page, its number clamped to those there are, and their number (one at least)."""
    pages = max(1, -(-df.count() // size))
    number = min(max(1, number), pages)
    return find_many(df, order_by=order_by, skip=(number - 1) * size, take=size), number, pages


def count_by(df: DataFrame, **filters: dict | None) -> DataFrame:
    """One row with the number of rows of each filter, in one pass. Filters are on columns only."""
    from millrace.operators.where import _all

    return df.agg(*[F.count_if(F.coalesce(_all(spec or {}), F.lit(False))).alias(name) for name, spec in filters.items()])


def aggregate(df: DataFrame, where_: dict | None = None, **by: list[str]) -> DataFrame:
    """One row of aggregates: count, sum, avg, min, max of the named columns. Sums of no rows are null."""
    functions = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    columns = [functions[op](c).alias(f"{op}_{'all' if c == '*' else c}") for op, names in by.items() for c in names]
    return where(df, where_).agg(*columns)


def group_by(df: DataFrame, by: list[str], aggregates: dict[str, Column], where_: dict | None = None, having: dict | None = None) -> DataFrame:
    """Groups with aggregates; ``having`` is a filter over the result's columns."""
    return where(where(df, where_).groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()]), having)


def top_per_parent(children: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """At most k rows of each key, with their ``rank``. Ties go by the order given; make it total."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return children.withColumn("rank", rank).filter(F.col("rank") <= k)


def nested(parents: DataFrame, key: str, children: DataFrame, child_key: str, columns: list[str], order: list[Column], take: int, name: str) -> DataFrame:
    """parents with an array of structs: the first ``take`` children of each, in order; empty if there are none."""
    top = top_per_parent(children, child_key, order, take)
    lists = top.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_list"))
    joined = parents.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
    items = F.transform(F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return joined.withColumn(name, items).drop("_list")


def child_count(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str, where_: dict | None = None) -> DataFrame:
    """parents with the number of their children that a filter holds for."""
    counts = where(children, where_).groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def in_rank_order(df: DataFrame, key: str, ranked: DataFrame) -> DataFrame:
    """The rows of df that ``ranked`` (key, rank) names, in that order."""
    return df.join(ranked, key).orderBy("rank")


def two_tiers(df: DataFrame, first: Column, order: list[Column], k: int) -> DataFrame:
    """k rows: those of the first tier in order, then others in the same order. A condition that is unknown is the second tier."""
    return df.orderBy(F.coalesce(first, F.lit(False)).desc(), *order).limit(k)


def free_slots(bookings: DataFrame, start: str, end: str, begin: Any, horizon: Any, capacity: int, exclude: Column | None = None) -> DataFrame:
    """One row, ``free``: capacity less the bookings that overlap the time from begin to horizon, 0 at least."""
    from millrace.functions.numbers import overlaps

    taken = bookings.filter(overlaps(F.col(start), F.col(end), F.lit(begin), F.lit(horizon)))
    taken = taken if exclude is None else taken.filter(~exclude)
    return taken.agg(F.greatest(F.lit(0), F.lit(capacity) - F.count("*")).alias("free"))


def one_child_each(parents: DataFrame, key: str, children: DataFrame, child_key: str, preferred: Column, order: list[Column], k: int, parent_order: list[Column]) -> DataFrame:
    """The first k parents, each with its first preferred child, or its first one; parents without children are left out."""
    rank = F.row_number().over(Window.partitionBy(child_key).orderBy(F.coalesce(preferred, F.lit(False)).desc(), *order))
    best = children.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return parents.join(best, F.col(key) == F.col(child_key)).orderBy(*parent_order).limit(k)
