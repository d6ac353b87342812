"""Changes as frames: inserts, updates, upserts, deletes, merges of entities, and plans with a content-addressed id.

Parquet has no transactions: a change makes a new frame, and publish() writes it beside the old one and swaps
the pointer file. A plan carries a digest of its actions and of the rows that it was made from; it is applied
only to rows that still have that digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(df: DataFrame, rows: DataFrame, key: list[str], skip_duplicates: bool = False) -> DataFrame:
    """df with new rows. Keys that are there already are skipped, or an error when the result is read."""
    fresh = rows.dropDuplicates(key) if skip_duplicates else rows
    there = df.select(*key).distinct()
    if skip_duplicates:
        return df.unionByName(fresh.join(there, key, "left_anti"), allowMissingColumns=True)
    marked = fresh.join(there.withColumn("_there", F.lit(True)), key, "left")
    first = marked.columns[0]
    guarded = F.when(F.col("_there"), F.raise_error("duplicate key")).otherwise(F.col(first))
    return df.unionByName(marked.withColumn(first, guarded).drop("_there"), allowMissingColumns=True)


def update(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    return df.select(*[F.when(test, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def increment(df: DataFrame, key: str, events: DataFrame, amount: str, column: str, guard: Column | None = None) -> DataFrame:
    """df with the sums of the events' amounts added to a column, where the guard (a condition on df) holds."""
    sums = events.groupBy(key).agg(F.sum(amount).alias("_sum"))
    add = F.coalesce("_sum", F.lit(0)) if guard is None else F.when(guard, F.coalesce("_sum", F.lit(0))).otherwise(0)
    joined = df.join(sums, key, "left")
    return joined.select(*[(F.col(c) + add).alias(c) if c == column else F.col(c) for c in df.columns])


def upsert(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key: new values replace old ones, null ones leave them, new keys are added."""
    new = rows.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in key])
    both = df.join(new, key, "full_outer")
    return both.select(*[F.col(c) if c in key or c not in rows.columns else F.coalesce(f"_n_{c}", c).alias(c) for c in df.columns])


def delete(df: DataFrame, test: Column) -> DataFrame:
    """Rows for which the test doesn't hold (those where it is unknown stay)."""
    return df.filter(~F.coalesce(test, F.lit(False)))


def cascade(children: DataFrame, fk: str, deleted: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children after their parents' deletion: gone too, or without a parent."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    if not set_null:
        return children.join(gone, F.col(fk) == F.col("_gone"), "left_anti")
    joined = children.join(gone, F.col(fk) == F.col("_gone"), "left")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == fk else F.col(c) for c in children.columns])


def merge_entities(children: DataFrame, fk: str, mapping: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Children of losers re-pointed to their winners (loser, winner); rows that then repeat ``unique`` are dropped, old ones first to stay."""
    joined = children.join(mapping, F.col(fk) == F.col("loser"), "left")
    moved = joined.select(*[F.coalesce("winner", fk).alias(c) if c == fk else F.col(c) for c in children.columns], F.col("winner").isNotNull().alias("_moved"))
    if unique:
        from millrace.operators.rank import first_per_key

        rest = [c for c in children.columns if c not in unique]
        moved = first_per_key(moved, unique, [F.col("_moved"), *[F.col(c) for c in rest]])
    return moved.drop("_moved")


def frame_digest(df: DataFrame) -> str:
    """A digest of a frame's rows, whatever their order: count, and sums of two independent hashes of each row."""
    columns = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null")) for c in sorted(df.columns)]
    row = F.concat_ws("\x1f", *columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in ("a", "b", "c", "d")]
    values = df.agg(F.count("*"), *sums).first()
    text = "|".join([*sorted(df.columns), *map(str, values)])
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


class StalePlan(RuntimeError):
    """The rows that a plan was made from have changed."""


class Plan:
    """Actions (key, column values) for a target, with the target's digest at the time."""

    def __init__(self, actions: DataFrame, target: DataFrame, key: list[str]):
        self.actions, self.key = actions, key
        self.guarded = [c for c in target.columns if c in actions.columns]
        self.target_digest = frame_digest(self._touched(target))
        self.plan_id = frame_digest(actions)

    def _touched(self, target: DataFrame) -> DataFrame:
        return target.join(self.actions.select(*self.key).distinct(), self.key, "left_semi").select(*self.guarded)

    def apply(self, target: DataFrame) -> DataFrame:
        """The target with the actions' values; StalePlan if a row to be changed isn't what it was."""
        if frame_digest(self._touched(target)) != self.target_digest:
            raise StalePlan(self.plan_id)
        return upsert(target, self.actions, self.key)

    def audit(self, after: DataFrame) -> DataFrame:
        """Actions of which the target doesn't show the values."""
        values = [c for c in self.actions.columns if c not in self.key and c in after.columns]
        new = self.actions.select(*self.key, *[F.col(c).alias(f"_n_{c}") for c in values])
        wrong = reduce(lambda a, b: a | b, [F.col(f"_n_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in values], F.lit(False))
        return new.join(after.select(*self.key, *values), self.key, "left").filter(wrong)

    def report_name(self, name: str, extension: str) -> str:
        return f"{name}-{self.plan_id[:16]}.{extension}"
