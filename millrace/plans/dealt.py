"""Joins whose work is in the pairs, not in the rows: a key's pairs are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], side: int = 1000) -> DataFrame:
    """left and right joined on equal keys; other columns must have different names.

    A key of many rows is cut into chunks of about ``side`` rows on either side, and each pair of chunks is a key of its
    own: a row is sent once for each chunk of the other side, and no task gets more than its share of a key's pairs.
    The tasks are as many as ``spark.sql.shuffle.partitions`` says, however few bytes there are.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.filter(" and ".join(f"`{k}` is not null" for k in keys)) for df in (left, right))
    chunks = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / side).alias(name))
    hot = chunks(left, "_lefts").join(chunks(right, "_rights"), keys).filter("_lefts > 1 or _rights > 1")

    def cut(df: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        number: Column = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(mine, F.lit(1))).alias(own)
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(theirs, F.lit(1)) - 1)).alias(other)
        return df.join(hot, keys, "left").select(*[F.col(f"`{c}`") for c in df.columns], number, copies).repartition(tasks, *keys, "_l", "_r")

    dealt = cut(left, "_lefts", "_rights", "_l", "_r").join(cut(right, "_rights", "_lefts", "_r", "_l"), [*keys, "_l", "_r"])
    return dealt.drop("_l", "_r")
