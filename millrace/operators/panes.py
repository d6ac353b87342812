"""Rolling windows from daily panes: counts by day are kept as a table, and windows are sums and differences of them.

A pane is a folder of its own, so moving on by a day reads the panes at the windows' edges, three for each length, not
the events of all the days in between. For every day of a range, windows are differences of running totals over panes.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_panes(events: DataFrame, at: str, keys: list[str], path: str) -> None:
    """Adds the panes of events (whole days) to a folder; a day that is there already is written anew."""
    counted = events.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day"), *keys).agg(F.count("*").alias("n"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in counted.drop("day").dtypes)
    writer = counted.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    events.sparkSession.createDataFrame([(kinds,)], "kinds string").coalesce(1).write.mode("overwrite").parquet(f"{path}-about")


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    kinds = spark.read.parquet(f"{path}-about").first().kinds
    return spark.read.schema(f"{kinds}, day date").parquet(path)


def figures(spark: SparkSession, path: str, keys: list[str], day: str, lengths: list[int]) -> DataFrame:
    """days, keys, current and previous for the windows that end with this day (itself included); keys without events are left out."""
    last = date.fromisoformat(day)
    panes = read_panes(spark, path)
    parts = []
    for length in lengths:
        first, before = (F.lit(last - timedelta(days=k * length - 1)) for k in (1, 2))
        own = panes.filter(F.col("day").between(before, F.lit(last)))
        sums = own.groupBy(*keys).agg(F.sum(F.when(F.col("day") >= first, F.col("n")).otherwise(0)).alias("current"), F.sum(F.when(F.col("day") < first, F.col("n")).otherwise(0)).alias("previous"))
        parts.append(sums.select(F.lit(length).alias("days"), *keys, "current", "previous"))
    return reduce(DataFrame.unionByName, parts)


def advance(spark: SparkSession, path: str, keys: list[str], known: DataFrame, day: str, lengths: list[int]) -> DataFrame:
    """The figures of a day from those of the day before: for each length, three panes are read."""
    new = date.fromisoformat(day)
    panes, parts = read_panes(spark, path), [known.select("days", *keys, "current", "previous")]
    for length in lengths:
        enters, moves, leaves = new, new - timedelta(days=length), new - timedelta(days=2 * length)
        edge = panes.filter(F.col("day").isin(enters, moves, leaves))
        change = lambda plus, minus: F.when(F.col("day") == F.lit(plus), F.col("n")).when(F.col("day") == F.lit(minus), -F.col("n")).otherwise(0)
        parts.append(edge.select(F.lit(length).alias("days"), *keys, change(enters, moves).alias("current"), change(moves, leaves).alias("previous")))
    total = reduce(DataFrame.unionByName, parts).groupBy("days", *keys).agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))
    return total.filter("current != 0 or previous != 0")


def rolling(spark: SparkSession, path: str, keys: list[str], first: str, last: str, lengths: list[int]) -> DataFrame:
    """day, days, keys, current, previous for every day from first to last: differences of each key's running totals."""
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    reach = start - timedelta(days=2 * max(lengths) - 1)
    panes = read_panes(spark, path).filter(F.col("day").between(F.lit(reach), F.lit(end)))
    span = (end - reach).days + 1
    days = spark.range(span).select(F.date_add(F.lit(reach), F.col("id").cast("int")).alias("day"))
    spine = panes.select(*keys).distinct().join(F.broadcast(days))  # a row for each key and day of the range
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], F.col("s.day") == F.col("p.day"))
    dense = spine.alias("s").join(panes.alias("p"), same, "left").select("s.day", *[F.col(f"s.{k}").alias(k) for k in keys], F.coalesce("p.n", F.lit(0)).alias("n"))
    number = F.datediff("day", F.lit(reach))
    parts = []
    for length in lengths:
        by = Window.partitionBy(*keys).orderBy(number)
        current = F.sum("n").over(by.rangeBetween(1 - length, 0))
        previous = F.coalesce(F.sum("n").over(by.rangeBetween(1 - 2 * length, -length)), F.lit(0))
        parts.append(dense.select("day", F.lit(length).alias("days"), *keys, current.alias("current"), previous.alias("previous")))
    return reduce(DataFrame.unionByName, parts).filter(F.col("day").between(F.lit(start), F.lit(end)) & ((F.col("current") > 0) | (F.col("previous") > 0)))
