"""Greedy groups around anchors, worked out in parallel: the same groups as one walk through the rows would give.

A row joins the first anchor before it that is like it, else it becomes one. So a row is an anchor if and only if no
earlier row that is like it is one, which rounds of joins can tell: a row without an undecided earlier neighbour is
decided, and so are all later neighbours of a new anchor.

Rows of one set of words are one row, the first. A block's rows are taken in stretches, each three times as long as all
before it: first they are compared with the anchors so far, and only what is left with each other. In a crowd of rows
that are alike, most are taken by a few early anchors, and no list of all pairs is ever made. Rows meet on words: of the
smaller of two sets that are alike, one of the rarest few words is in the other.

A block is never gathered. Its order comes from a range sort of all rows, which may cut it anywhere. Where rows depend on
each other in a long chain, the links of that chain are walked through in one task, if there are few enough; else the
rounds go on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.graph import connected
from millrace.plans.scratch import write_table

#: Rows of a block's first stretch, how much longer all stretches so far are after the next, rounds before chains are looked for.
_FIRST, _GROWTH, _ROUNDS = 16, 4, 3


def _in_order(df: DataFrame, keys: list[str], id_col: str, text: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """All rows (row, block, id, words), and each block's distinct sets of words: block, no (rising with the order), place, id, words."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")))
    fields = [x for k, c in enumerate([*order, F.col(id_col)]) for x in (c.isNull().alias(f"n{k}"), c.alias(f"o{k}"))]
    rows = df.select(F.struct(*keys, id_col).alias("row"), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("block"), F.col(id_col).alias("id"), F.struct(*fields).alias("by"), words.alias("words"))
    sets = rows.filter(F.size("words") > 0).groupBy("block", "words").agg(F.min_by("id", "by").alias("id"), F.min("by").alias("by"))
    dealt = sets.repartitionByRange("block", "by").sortWithinPartitions("block", "by")
    numbered = write_table(dealt.select("block", "id", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("no")), "ordered")
    parts = numbered.groupBy("block", "part").agg(F.count("*").alias("n"), F.min("no").alias("first"))
    before = F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("block", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows, numbered.join(parts, ["block", "part"]).select("block", "no", (F.col("no") + F.col("shift")).alias("place"), "id", "words")


def _rarest_first(sets: DataFrame, threshold: float) -> DataFrame:
    """sets with ``few``: as many of a set's rarest words as it takes for one of them to be in any larger set that is like it."""
    each = sets.select("block", "no", F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = each.groupBy("block", "word").agg(F.count("*").alias("seen"))
    listed = each.join(seen, ["block", "word"]).groupBy("no", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "word"))).alias("w"))  # a row's own words
    take = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)).cast("int") + 1
    few = listed.select("no", F.slice(F.transform("w", lambda x: x["word"]), 1, F.greatest(take, F.lit(1))).alias("few"))
    return sets.join(few, "no")


def _alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: numbers of an earlier row of left and a later one of right that share enough; pairs may repeat."""

    def met(mine: str, theirs: str, smaller: Column) -> DataFrame:
        x = left.select("block", F.col("no").alias("a"), F.col("words").alias("x"), F.explode(mine).alias("word"))
        y = right.select("block", F.col("no").alias("b"), F.col("words").alias("y"), F.explode(theirs).alias("word"))
        shared = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
        return x.join(y, ["block", "word"]).filter((F.col("a") < F.col("b")) & smaller).filter(shared >= threshold).select("a", "b")

    return met("few", "words", F.size("x") <= F.size("y")).unionByName(met("words", "few", F.size("x") > F.size("y")))


def _walk(links: DataFrame, most: int) -> DataFrame | None:
    """no, anchor (whether it is one) for the rows of chains with ``most`` links at most; None if there are none."""
    groups = connected(links)
    marked = links.join(groups.withColumnRenamed("node", "a"), "a")
    small = marked.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("group")
    found = write_table(marked.join(small, "group"), "chains")
    if found.isEmpty():
        return None

    def walk(chain: pd.DataFrame) -> pd.DataFrame:
        before = chain.groupby("b")["a"].apply(list).to_dict()
        anchors: set[int] = set()
        rows = sorted({*chain["a"], *chain["b"]})
        for row in rows:
            if anchors.isdisjoint(before.get(row, ())):
                anchors.add(row)
        return pd.DataFrame({"no": rows, "anchor": [row in anchors for row in rows]})

    return found.groupBy("group").applyInPandas(walk, "no long, anchor boolean")


def _first_independent(links: DataFrame, most: int) -> DataFrame:
    """no, anchor for the rows of links (a before b): a row is an anchor unless an earlier neighbour is one."""
    done: list[DataFrame] = []
    rounds = 0
    while not links.isEmpty():
        rounds += 1
        decided = _walk(links, most) if rounds > _ROUNDS else None
        if decided is None:
            # rows that no undecided row comes before are anchors, their later neighbours aren't
            heads = links.select(F.col("a").alias("no")).distinct().join(links.select(F.col("b").alias("no")), "no", "left_anti")
            taken = links.join(heads.select(F.col("no").alias("a")), "a", "left_semi").select(F.col("b").alias("no")).distinct()
            decided = heads.withColumn("anchor", F.lit(True)).unionByName(taken.withColumn("anchor", F.lit(False)))
        decided = write_table(decided, "decided")
        done.append(decided)
        gone = decided.select("no", "anchor")
        rest = links.join(gone.select(F.col("no").alias("a")), "a", "left_anti").join(gone.select(F.col("no").alias("b")), "b", "left_anti")
        # what only members stood before is an anchor, as its links are gone
        lone = links.select(F.col("b").alias("no")).distinct().join(gone, "no", "left_anti").join(rest.select(F.explode(F.array("a", "b")).alias("no")), "no", "left_anti")
        done.append(write_table(lone.withColumn("anchor", F.lit(True)), "decided"))
        links = write_table(rest, "undecided")
    out = done[0] if done else links.select(F.col("a").alias("no"), F.lit(True).alias("anchor"))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def greedy_groups(df: DataFrame, keys: list[str], id_col: str, text: str, order: str | list[Column], threshold: float, most_links: int = 50_000) -> DataFrame:
    """keys, id_col, anchor: rows of a block in order join the first anchor whose words overlap theirs enough, else become one.

    The overlap is shared words over the smaller set; it isn't transitive. Rows without words are groups of their own.
    Rows of one place in the order follow their ids, which must be unique within a block. Nulls in the order come last.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is a share above 0")
    spark = df.sparkSession
    order = [F.col(order)] if isinstance(order, str) else order
    rows, sets = _in_order(df, keys, id_col, text, order)
    sets = write_table(_rarest_first(sets, threshold), "sets")
    longest = sets.agg(F.max("place")).first()[0]
    anchors, members = sets.limit(0), None
    start, end = 0, _FIRST
    while longest is not None and start <= longest:
        stretch = sets.filter(F.col("place").between(start, end - 1))
        taken = write_table(_alike(anchors, stretch, threshold).groupBy("b").agg(F.min("a").alias("a")), "taken")
        left = write_table(stretch.join(taken.select(F.col("b").alias("no")), "no", "left_anti"), "left")
        links = write_table(_alike(left, left, threshold).distinct(), "alike")
        decided = write_table(_first_independent(links, most_links), "anchors")
        heads = write_table(left.join(decided.filter("not anchor").select("no"), "no", "left_anti"), "heads")
        joined = links.join(decided.filter("anchor").select(F.col("no").alias("a")), "a", "left_semi")
        joined = joined.join(decided.filter("not anchor").select(F.col("no").alias("b")), "b", "left_semi").groupBy("b").agg(F.min("a").alias("a"))
        found = taken.select("a", "b").unionByName(joined.select("a", "b")).unionByName(heads.select(F.col("no").alias("a"), F.col("no").alias("b")))
        members = found if members is None else members.unionByName(found)
        anchors = heads.select(sets.columns) if start == 0 else anchors.unionByName(heads.select(sets.columns))
        start, end = end, end * _GROWTH
    if members is None:
        members = spark.createDataFrame([], "a long, b long")
    named = members.join(sets.select(F.col("no").alias("a"), F.col("id").alias("anchor")), "a")
    of_set = named.join(sets.select(F.col("no").alias("b"), "block", "words"), "b").select("block", "words", "anchor")
    found = rows.join(of_set, ["block", "words"], "left")
    return found.select(*[F.col(f"row.`{k}`").alias(k) for k in [*keys, id_col]], F.coalesce("anchor", "id").alias("anchor"))


def two_pass_places(df: DataFrame, point: list[str], block: list[str], id_col: str, text: str, source_rank: Column, threshold: float = 0.45) -> DataFrame:
    """The rows of df that stay: of each exact point that of the best source; of those, in blocks, the anchors of greedy_groups().

    Rows are taken by source, best first, so an anchor never has to give way to a better one; ties go to the smaller id.
    """
    best = F.min_by(F.struct("*"), F.struct((-source_rank).alias("r"), F.col(id_col).alias("i")))
    once = write_table(df.groupBy(*[F.col(c).alias(f"_{c}") for c in point]).agg(best.alias("row")).select("row.*"), "points")
    groups = greedy_groups(once, block, id_col, text, [-source_rank], threshold)
    return once.join(groups.filter(F.col("anchor") == F.col(id_col)).select(id_col), id_col, "left_semi")
