"""The best other items for every item, by shared keys, without listing all pairs that share one.

Items with the same owner and the same keys are one profile, and score alike with all others; of a profile, others only
ever see its first item, as a list has one row of each owner. So pairs are made of profiles, and lists of items last.

A key that few profiles have pairs them. A key that many have (``hot``) doesn't: profiles with the same hot keys are one
signature, pairs are made of signatures, and of each only the first few owners go on. That is enough: an owner
behind them has as many owners before it as a list is long, and whatever else those share only lifts them. Pairs that
share a rare key too are met by that key, and every pair that is met is scored by all keys of both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import write_table


def _first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda a, x: a + x["w"])


def related_items(items: DataFrame, id_col: str, owner: str, links: list[tuple[DataFrame, float]], same_owner: float, k: int, hot: int = 500) -> DataFrame:
    """id_col, other, score, rank: for each item the k best others, one of each owner.

    A score is the weight of each key that both have in the frames of links (id_col, key), and same_owner if that is
    equal; weights must be positive. Ties go to the smaller id; items that share nothing aren't listed; null owners are
    no key, but one owner where a list has one row of each. hot: from how many profiles on a key is hot.
    """
    base = items.select(F.col(id_col).alias("id"), F.col(owner).cast("string").alias("owner"))
    keys = [base.filter("owner is not null").select("id", F.concat(F.lit("o:"), "owner").alias("key"), F.lit(float(same_owner)).alias("w"))]
    for n, (frame, weight) in enumerate(links):
        keys.append(frame.filter("key is not null").select(F.col(id_col).alias("id"), F.concat(F.lit(f"{n}:"), F.col("key").cast("string")).alias("key"), F.lit(float(weight)).alias("w")))
    own = reduce(DataFrame.unionByName, keys).distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "w"))).alias("keys"))  # an item's own keys
    rows = write_table(base.join(own, "id").withColumn("group", F.coalesce(F.concat(F.lit("="), "owner"), F.lit(""))), "items")
    firsts = _first(rows, ["group", "keys"], [F.col("id")], 2).groupBy("group", "keys").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # two ids
    profiles = write_table(firsts.select(F.col("ids")[0].alias("p"), F.get("ids", F.lit(1)).alias("second"), "group", "keys"), "profiles")
    each = profiles.select("p", F.inline("keys"))
    often = write_table(each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "hot_keys")

    # pairs by rare keys
    rare = each.join(often, "key", "left_anti").select("p", "key")
    pairs = rare.join(rare.withColumnRenamed("p", "q"), "key").filter("p != q").select("p", "q").distinct()

    # pairs by hot keys: signatures, and of each the first owners
    shared = each.join(often, "key").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("key", "w"))).alias("signature"))
    signed = write_table(profiles.join(shared, "p").select("p", "group", "signature"), "signed")
    heads = _first(signed, ["signature", "group"], [F.col("p")], 2)  # the first profile, and one more for the first itself
    least = heads.groupBy("signature", "group").agg(F.min("p").alias("least"))
    owners = _first(least, ["signature"], [F.col("least")], k + 2).drop("least")
    heads = heads.join(owners, ["signature", "group"])
    signatures = signed.select("signature").distinct()
    by_key = signatures.select("signature", F.explode(F.col("signature.key")).alias("key"))
    met = by_key.join(by_key.withColumnRenamed("signature", "theirs"), "key").select("signature", "theirs").distinct()
    met = met.withColumn("hot_score", _weight(F.array_intersect("signature", "theirs")))
    seen = met.join(heads.select(F.col("signature").alias("theirs"), "group", F.col("p").alias("q")), "theirs")
    seen = _first(seen, ["signature", "group"], [F.desc("hot_score"), F.col("q")], 2)
    best = seen.groupBy("signature", "group").agg(F.max(F.struct("hot_score", (-F.col("q")).alias("q"))).alias("b"))
    owners = _first(best, ["signature"], [F.desc("b")], k + 2).select("signature", "group")
    seen = seen.join(owners, ["signature", "group"]).select("signature", "q")
    pairs = pairs.union(signed.join(seen, "signature").filter("p != q").select("p", "q")).distinct()

    # scores by all keys, the best of each owner, the first owners
    mine, theirs = profiles.select("p", "keys"), profiles.select(F.col("p").alias("q"), F.col("keys").alias("their_keys"), "group")
    scored = pairs.join(mine, "p").join(theirs, "q").select("p", "q", "group", _weight(F.array_intersect("keys", "their_keys")).alias("score"))
    order = [F.desc("score"), F.col("q")]
    listed = write_table(_first(_first(scored, ["p", "group"], order, 1), ["p"], order, k + 1), "lists")

    # items: their profile's list, and the first other item of their own profile
    placed = rows.select("id", "group", "keys").join(profiles.select("p", "second", "group", "keys"), ["group", "keys"])
    others = placed.select("id", "p").join(listed, "p").select("id", F.col("q").alias("other"), "group", "score")
    same = placed.select("id", F.when(F.col("id") == F.col("p"), F.col("second")).otherwise(F.col("p")).alias("other"), "group", _weight(F.col("keys")).alias("score"))
    every = others.unionByName(same.filter("other is not null"))
    order = [F.desc("score"), F.col("other")]
    final = _first(every, ["id", "group"], order, 1).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k)
    return final.select(F.col("id").alias(id_col), "other", "score", "rank")
