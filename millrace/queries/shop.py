"""Home page picks, capacity, relations, places."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import places
from millrace.operators import find
from millrace.plans.catalog import Catalog, ForeignKey, materialise
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()


def catalog(spark, sf):
    names = ["region", "nation", "customer", "supplier", "orders", "lineitem", "part"]
    keys = [
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ]
    return Catalog({n: table(spark, sf, n) for n in names}, keys)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, o_totalprice DESC, o_orderkey LIMIT 18")
def two_tier_fill(spark, sf):
    return find.two_tiers(table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", [F.desc("o_totalprice"), F.col("o_orderkey")], 18).select("o_orderkey")


@query("SELECT greatest(0, 5000 - count(*)) AS free FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-06-01'")
def free_slots(spark, sf):
    booked = table(spark, sf, "orders").select(F.col("o_orderdate").alias("start"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("end"))
    return find.free_slots(booked, "start", "end", datetime(1997, 6, 1), datetime(1998, 1, 1), 5000)


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) = 1) ON o_custkey = c_custkey
 ORDER BY c_acctbal DESC, c_custkey LIMIT 4""")
def one_child_each(spark, sf):
    rows = find.one_child_each(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", [F.col("o_orderdate"), F.col("o_orderkey")], 4, [F.desc("c_acctbal"), F.col("c_custkey")])
    return rows.select("c_custkey", "o_orderkey")


@query("""SELECT c_nationkey AS id, 'customer' AS "table", 'c_nationkey' AS "column", count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', 's_nationkey', count(*) FROM supplier GROUP BY 1""")
def relation_counts(spark, sf):
    ids = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    return catalog(spark, sf).relation_counts("nation", ids)


@query("""SELECT 'nation' AS "table", 'n_regionkey' AS "column", (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS n UNION ALL SELECT 'customer', 'c_nationkey', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))
 UNION ALL SELECT 'supplier', 's_nationkey', (SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'orders', 'o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
 UNION ALL SELECT 'lineitem', 'l_orderkey', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'lineitem', 'l_partkey', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
 UNION ALL SELECT 'lineitem', 'l_suppkey', (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))""")
def orphan_keys(spark, sf):
    return catalog(spark, sf).orphans()


@query("SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS words, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def search_index(spark, sf):
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return materialise(rows.select("c_custkey", F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("words"), "n_name"), "search_index")


@query("""SELECT c_custkey, '105' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS postal, CAST(c_custkey % 90 + 1 AS VARCHAR) AS numbers, 'Athens' AS place FROM customer""")
def address_parts(spark, sf):
    line = F.concat(F.lit("Ermou "), (F.col("c_custkey") % 90 + 1).cast("string"), F.lit(", Athina 105 "), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf, "customer").select("c_custkey", places.postal_code(line).alias("postal"), F.array_join(places.street_numbers(line), ",").alias("numbers"), places.locality(line, [("αθήνα", "Athens"), ("athina", "Athens")]).alias("place"))
