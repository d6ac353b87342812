"""The relations of a set of tables, and what can be derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import write_table


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    key: str
    on_delete: str = "cascade"


class Catalog:
    """Frames by name, with their foreign keys."""

    def __init__(self, frames: dict[str, DataFrame], keys: list[ForeignKey]):
        self.frames, self.keys = frames, keys

    def references(self, parent: str) -> list[ForeignKey]:
        """The keys that point to a table, by table and column."""
        return sorted((k for k in self.keys if k.parent == parent), key=lambda k: (k.table, k.column))

    def relation_counts(self, parent: str, entities: DataFrame) -> DataFrame:
        """id, table, column, n: how many rows of each table refer to each of the entities (a column ``id``); absent if none."""
        parts = []
        for k in self.references(parent):
            rows = self.frames[k.table].select(F.col(k.column).alias("id")).join(entities, "id", "left_semi")
            parts.append(rows.groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(k.table).alias("table"), F.lit(k.column).alias("column"), "n"))
        return reduce(DataFrame.unionByName, parts)

    def _deletion_order(self, root: str) -> list[str]:
        """The root and the tables that go with its rows, each after all of its parents among them."""
        reached, todo = {root}, [root]
        while todo:
            parent = todo.pop()
            new = {k.table for k in self.references(parent) if k.on_delete == "cascade"} - reached
            reached |= new
            todo += new
        order: list[str] = []
        while len(order) < len(reached):
            free = sorted(t for t in reached - {*order} if all(k.parent in order for k in self.keys if k.table == t and k.parent in reached and k.on_delete == "cascade" and t != root))
            if not free or (root in {k.table for k in self.keys if k.parent in reached and k.on_delete == "cascade"}):
                raise ValueError(f"keys that cascade form a cycle: {', '.join(sorted(reached - {*order}))}")
            order += free
        return order

    def delete(self, root: str, rows: DataFrame) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
        """Of each table that the deletion of some rows of root bears on: the rows that go, those that lose a parent, and what is left.

        Keys that cascade take their rows along, through any number of tables; others (``set null``) are emptied in rows that
        stay. Each table's lost rows are written once, as further tables are found from them.
        """
        gone = {root: write_table(rows, "deleted")}
        for name in self._deletion_order(root)[1:]:
            lost = None
            for k in (k for k in self.keys if k.table == name and k.parent in gone and k.on_delete == "cascade"):
                own = self.frames[name].join(gone[k.parent].select(F.col(k.key).alias(k.column)).distinct(), k.column, "left_semi")
                lost = own if lost is None else lost.unionByName(own).distinct()
            gone[name] = write_table(lost.select(*self.frames[name].columns), "deleted")
        out = {}
        for name, frame in self.frames.items():
            empties = [k for k in self.keys if k.table == name and k.parent in gone and k.on_delete != "cascade"]
            if name not in gone and not empties:
                continue
            left = frame.exceptAll(gone[name]) if name in gone else frame
            marks = []
            for i, k in enumerate(empties):
                dead = gone[k.parent].select(F.col(k.key).alias(f"_gone{i}")).distinct()
                left = left.join(dead, F.col(k.column) == F.col(f"_gone{i}"), "left")
                marks.append(F.col(f"_gone{i}").isNotNull())
            touched = reduce(lambda a, b: a | b, marks) if marks else F.lit(False)
            emptied = left.filter(touched).select(*frame.columns)
            values = {k.column: F.when(~m, F.col(k.column)) for k, m in zip(empties, marks, strict=True)}
            left = left.select(*[values.get(c, F.col(c)).alias(c) for c in frame.columns])
            out[name] = (gone.get(name, frame.limit(0)), emptied, left)
        return out

    def deletion_counts(self, root: str, rows: DataFrame) -> DataFrame:
        """table, deleted, emptied: what a deletion bears on."""
        parts = []
        for name, (lost, emptied, _) in self.delete(root, rows).items():
            counts = lost.agg(F.count("*").alias("deleted")).join(emptied.agg(F.count("*").alias("emptied")))
            parts.append(counts.select(F.lit(name).alias("table"), "deleted", "emptied"))
        return reduce(DataFrame.unionByName, parts)

    def orphans(self) -> DataFrame:
        """table, column, n: rows whose key names no row."""
        parts = []
        for k in self.keys:
            known = self.frames[k.parent].select(F.col(k.key).alias(k.column))
            lost = self.frames[k.table].filter(F.col(k.column).isNotNull()).select(k.column).join(known, k.column, "left_anti")
            parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(k.table).alias("table"), F.lit(k.column).alias("column"), "n"))
        return reduce(DataFrame.unionByName, parts)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A read model, written once and read from then on."""
    return write_table(df, name)
