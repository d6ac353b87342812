from pyspark.sql import functions as F

from millrace.operators import linkage
from millrace.plans.dealt import join_dealt


def most_rows(df) -> int:
    """The most rows that a step of the plan made; df has been collected."""

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own, below = plan.metrics().get("numOutputRows"), plan.children()
        return max([own.get().value() if own.isDefined() else 0, *[walk(below.apply(i)) for i in range(below.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_key_of_many_rows_is_dealt(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 250, "hot").when(F.col("id") < 290, F.col("id").cast("string")).alias("k"))
    right = spark.range(280).select(F.col("id").alias("b"), F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dealt = join_dealt(left, right, ["k"], side=20)
    got = sorted(map(tuple, dealt.select("k", "a", "b").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect())) and len(got) == 250 * 200 + 30
    assert max(r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 20_000


def test_names_that_have_most_in_common_are_not_all_paired(spark):
    firms = lambda low, name: spark.range(low, low + 1500).select(F.col("id").alias(name), F.lit("").alias("d"), F.lit("").alias("r"), F.concat(F.lit("firm number "), "id").alias("name"))
    found = linkage.duplicate_audit(firms(100_000, "a"), firms(101_000, "b"), "a", "b", "d", "r", "name")
    got = {(r.a, r.b): r.confidence for r in found.collect()}
    near = lambda x, y: sum(p != q for p, q in zip(str(x), str(y), strict=True)) <= 1 or str(x)[1:] == str(y)[:-1] or str(x)[:-1] == str(y)[1:]
    assert all(v == (97 if a == b else 92) for (a, b), v in got.items())
    assert {p for p in got if near(*p)} == {(a, b) for a in range(100_000, 101_500) for b in range(101_000, 102_500) if sum(p != q for p, q in zip(str(a), str(b), strict=True)) <= 1}
    assert most_rows(found) < 300_000  # of 2,250,000 pairs


def test_every_pair_of_rows_has_its_surest_reason(spark):
    new = spark.createDataFrame([(1, "x", "r", "n"), (1, "x", "r", "n"), (2, "y", "r", "the name of a firm"), (3, None, "", "the name of a farm"), (4, "", None, None)], "a int, d string, r string, name string")
    known = spark.createDataFrame([(1, "x", "r", "n"), (2, None, "r", "the name of a firm"), (3, "z", "", "the name of a firm"), (4, "", None, "")], "b int, d string, r string, name string")
    got = sorted(map(tuple, linkage.duplicate_audit(new, known, "a", "b", "d", "r", "name").collect()))
    assert got == [(1, 1, 100), (1, 1, 100), (1, 2, 98), (1, 2, 98), (2, 1, 98), (2, 2, 98), (2, 3, 97), (3, 2, 92), (3, 3, 92)]


def rows_in_a_block(spark, n):
    size = F.when(F.col("id") % 9 > 0, F.col("id") % 100).cast("int")
    return spark.range(n).select("id", size.alias("size"), F.when(F.col("id") % 7 > 0, "x").alias("name"), F.lit("y").alias("brand"))


def test_neighbouring_values_alone_are_paired(spark):
    rows = rows_in_a_block(spark, 700)
    found = linkage.pairs_in_block(rows, "id", ["name", "brand"], ["size"], lambda a, b: F.abs(a("size") - b("size")) <= 3, near=("size", 3))
    known = [(r.id, r["size"]) for r in rows.collect() if r.name and r["size"] is not None]
    assert sorted(map(tuple, found.collect())) == [(i, j) for i, x in known for j, y in known if i < j and abs(x - y) <= 3]
    assert most_rows(found) < len(known) ** 2 / 8
    every = linkage.pairs_in_block(rows, "id", "name", ["size"], lambda a, b: F.abs(a("size") - b("size")) <= 3)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, found.collect()))


def test_chains_lead_to_the_groups_of_all_pairs(spark):
    rows = rows_in_a_block(spark, 90).withColumn("size", F.col("size") * 2 - F.when(F.col("size") > 50, 20).otherwise(0)).filter("size % 7 > 2")
    rows = rows.union(rows.filter("id < 40").selectExpr("id + 1000", "size + 1000", "'z'", "'y'")).union(rows.selectExpr("id % 5 + 500", "size", "name", "brand"))
    links = linkage.chain_links(rows, "id", ["name", "brand"], ("size", 3))
    pairs = linkage.pairs_in_block(rows, "id", ["name", "brand"], ["size"], lambda a, b: F.abs(a("size") - b("size")) <= 3)
    got = sorted(map(tuple, linkage.components(links).collect()))
    assert got == sorted(map(tuple, linkage.components(pairs).collect())) and len({g for _, g in got}) > 1
    assert links.count() <= 2 * rows.count()
