"""Connected groups of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import write_table


def connected(links: DataFrame, about: int | None = None) -> DataFrame:
    """node, group (the smallest node of the group) for each node of the links (a, b), two bigint columns.

    Alternates large and small stars: every node hooks its larger, then its smaller neighbours to the least of
    them, which makes a star of each group in a few rounds. A node's links are never gathered; the least
    neighbour is an aggregate, joined back to the links. Each round is written to the shared folder. about: how many
    links there are, if the caller knows.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = write_table(edges, "links", most_files=about and 3 + about // 200_000)
    last, files = None, 3 + (about or edges.count()) // 200_000
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct()
        edges = write_table(small, "links", most_files=files)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
        last = state
