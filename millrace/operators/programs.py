"""Programs: items of one offer that differ in their amounts, found by words, with no list of all pairs of a block.

Rows of one block with the same set of words are one class, named by its least id. Classes meet on words: two sets that
share enough have one of their rarest words in common, and of the words that both could still share there are enough from
there on. A pair of classes is compared once. What hangs together does so through classes, so copies are never paired.

Defined results: ids are whole numbers from 0 on, each of one row. Rows without a block, or without words (null, empty or
blank), are in no class and like nothing; rows without amounts are in no program.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.graph import connected
from millrace.plans.scratch import write_table


def _set_of(text: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")))


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """block, class, n, place, word: of each set as many of its rarest words as it takes to meet all sets that are like it."""
    each = sets.select("block", "class", F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = each.groupBy("block", "word").agg(F.count("*").alias("seen"))
    own = each.join(seen, ["block", "word"]).groupBy("block", "class", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "word"))).alias("own"))  # a set's own words
    shared = F.ceil(F.col("n") * percent / 100 - 1e-9).cast("int")
    few = F.slice(F.transform("own", lambda x: x["word"]), F.lit(1), F.col("n") - F.greatest(shared, F.lit(1)) + 1)
    return own.select("block", "class", "n", F.posexplode(few).alias("place", "word"))


def alike_sets(df: DataFrame, id_col: str, block: str, text: str, percent: int = 72) -> tuple[DataFrame, DataFrame]:
    """(id, class) of all rows with words, and (a, b, shared, larger) of the pairs of classes a < b of a block whose sets
    share ``percent`` of the larger one or more."""
    rows = df.filter(F.col(block).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(block).alias("block"), _set_of(text).alias("words")).filter(F.size("words") > 0)
    sets = write_table(rows.groupBy("block", "words").agg(F.min("id").alias("class")), "sets")
    few = write_table(_rarest(sets, percent), "rarest")
    x = few.select("block", "word", F.col("class").alias("a"), F.col("n").alias("n"), F.col("place").alias("i"))
    y = few.select("block", "word", F.col("class").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"))
    # where two sets first meet, no more can be shared than what either has left
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    met = x.join(y, ["block", "word"]).filter((F.col("a") < F.col("b")) & (100 * left >= percent * F.greatest("n", "m"))).select("a", "b").distinct()
    words = lambda c, w: sets.select(F.col("class").alias(c), F.col("words").alias(w))
    both = met.join(words("a", "u"), "a").join(words("b", "v"), "b").select("a", "b", F.size(F.array_intersect("u", "v")).alias("shared"), F.greatest(F.size("u"), F.size("v")).alias("larger"))
    return rows.join(sets, ["block", "words"]).select("id", "class"), both.filter(100 * F.col("shared") >= percent * F.col("larger"))


def _links(rows: DataFrame, text: str, percent: int, node: Column) -> DataFrame:
    """a, b: rows and the classes (as nodes) that tie them together, by one column of words."""
    members, alike = alike_sets(rows, "id", "block", text, percent)
    members = write_table(members.join(rows.select("id", "amounts"), "id"), "members")
    span = members.groupBy("class").agg(F.min("amounts").alias("low"), F.max("amounts").alias("high"))
    end = lambda c: span.select(F.col("class").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    same = (F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))
    ties = write_table(alike.join(end("a"), "a").join(end("b"), "b").filter(~same).select("a", "b"), "ties")
    tied = span.filter(F.col("low") != F.col("high")).select("class").union(ties.select("a")).union(ties.select("b")).distinct()
    inside = members.join(tied, "class").select(F.col("id").alias("a"), node.alias("b"))
    ends = ties.select(F.col("a").alias("class"), "b").select(node.alias("a"), F.col("b").alias("class")).select("a", node.alias("b"))
    return inside.unionByName(ends)


def programs(df: DataFrame, id_col: str, block: str, amounts: str, texts: list[str], percent: int = 72) -> DataFrame:
    """id, program (the least id in it) of the rows that hang together with others: two of a block do if their amounts (an
    array, whatever its order) differ and the words of one of ``texts`` are alike.

    Rows of equal words and equal amounts aren't tied by themselves, but through any third one that is tied to both. So a
    class ties its rows if it has two lists of amounts, or is like a class with another one.
    """
    listed = F.array_sort(F.array_distinct(F.filter(F.col(amounts), lambda x: x.isNotNull())))
    columns = [F.col(t).alias(f"text{k}") for k, t in enumerate(texts)]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(block).alias("block"), listed.alias("amounts"), *columns).filter("block is not null and size(amounts) > 0")
    node = lambda k: -(F.col("class") * len(texts) + k) - 1  # noqa: E731  classes are the numbers below 0
    groups = connected(reduce(DataFrame.unionByName, [_links(rows, f"text{k}", percent, node(k)) for k in range(len(texts))]))
    members = groups.filter("node >= 0")
    return members.join(members.groupBy("group").agg(F.min("node").alias("program")), "group").select(F.col("node").alias("id"), "program")
