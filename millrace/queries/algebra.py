"""Filters, relations, order, paging, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import find
from millrace.operators.where import Ref, Relation, where
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def orders(spark, sf):
    return table(spark, sf, "orders")


def customer_relations(spark, sf):
    lines = Relation(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return {
        "orders": Relation(orders(spark, sf), "c_custkey", "o_custkey", {"lines": lines}),
        "nation": Relation(table(spark, sf, "nation"), "c_nationkey", "n_nationkey", {"region": Relation(table(spark, sf, "region"), "n_regionkey", "r_regionkey")}),
    }


def order_relations(spark, sf):
    return {
        "lines": Relation(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey"),
        "customer": Relation(table(spark, sf, "customer"), "o_custkey", "c_custkey"),
    }


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice >= 400000 OR o_orderpriority = '1-URGENT') AND NOT (o_orderpriority = '5-LOW')")
def where_and_or_not(spark, sf):
    spec = {"o_orderstatus": "F", "OR": [{"o_totalprice": {"gte": 400000}}, {"o_orderpriority": "1-URGENT"}], "NOT": {"o_orderpriority": "5-LOW"}}
    return where(orders(spark, sf), spec).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def where_in_notin(spark, sf):
    return where(orders(spark, sf), {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}, "o_orderstatus": {"notIn": ["P"]}}).select("o_orderkey")


@query("SELECT 0 AS n_in, (SELECT count(*) FROM orders) AS n_not_in")
def where_in_empty(spark, sf):
    both = find.count_by(orders(spark, sf), n_in={"o_orderkey": {"in": []}}, n_not_in={"o_orderkey": {"notIn": []}})
    return both.select(F.col("n_in").cast("int"), "n_not_in")


@query("SELECT event_id, nullif(event_type, 'view') AS kind FROM events WHERE nullif(event_type, 'view') IS NULL OR nullif(event_type, 'view') <> 'click'")
def where_null(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return where(df, {"OR": [{"kind": None}, {"kind": {"not": "click"}}]})


@query("SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 250000")
def where_range(spark, sf):
    return where(orders(spark, sf), {"o_totalprice": {"gte": 1000, "lt": 250000}}).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND NOT contains(p_name, '%')")
def where_contains_ci(spark, sf):
    spec = {"p_name": {"contains": "RED", "mode": "insensitive"}, "NOT": {"p_name": {"contains": "%"}}}
    return where(table(spark, sf, "part"), spec).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE starts_with(p_type, 'ECO')")
def where_startswith(spark, sf):
    return where(table(spark, sf, "part"), {"p_type": {"startsWith": "ECO"}}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE ends_with(p_name, 'bolt')")
def where_endswith(spark, sf):
    return where(table(spark, sf, "part"), {"p_name": {"endsWith": "bolt"}}).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount < l_tax")
def where_field_ref(spark, sf):
    return where(table(spark, sf, "lineitem"), {"l_discount": {"lt": Ref("l_tax")}}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def where_json_path(spark, sf):
    return where(table(spark, sf, "events"), {"props": {"path": ["k"], "gte": 50}}).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def rel_is(spark, sf):
    return where(orders(spark, sf), {"customer": {"is": {"c_mktsegment": "MACHINERY"}}}, order_relations(spark, sf)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def rel_is_not(spark, sf):
    return where(orders(spark, sf), {"customer": {"isNot": {"c_acctbal": {"gt": 0}}}}, order_relations(spark, sf)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49 AND l_returnflag = 'R')")
def rel_some(spark, sf):
    return where(orders(spark, sf), {"lines": {"some": {"l_quantity": {"gte": 49}, "l_returnflag": "R"}}}, order_relations(spark, sf)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rel_none(spark, sf):
    return where(orders(spark, sf), {"lines": {"none": {}}}, order_relations(spark, sf)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT coalesce(l_quantity >= 10, false))")
def rel_every(spark, sf):
    return where(orders(spark, sf), {"lines": {"every": {"l_quantity": {"gte": 10}}}}, order_relations(spark, sf)).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1))""")
def rel_some_two_hop(spark, sf):
    spec = {"orders": {"some": {"o_orderstatus": "O", "lines": {"some": {"l_discount": {"gte": 0.1}}}}}}
    return where(table(spark, sf, "customer"), spec, customer_relations(spark, sf)).select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")
def rel_in_or(spark, sf):
    spec = {"OR": [{"c_acctbal": {"lt": 0}}, {"orders": {"some": {"o_totalprice": {"gt": 480000}}}}]}
    return where(table(spark, sf, "customer"), spec, customer_relations(spark, sf)).select("c_custkey")


@query("""SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def enrich_parent(spark, sf):
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    fitting = where(table(spark, sf, "customer"), {"nation": {"region": {"r_name": "ASIA"}}}, customer_relations(spark, sf))
    return fitting.join(named, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "r_name")


@query("""SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3), '') AS top_orders FROM customer LEFT JOIN (
 SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F')
 ON o_custkey = c_custkey GROUP BY c_custkey""")
def nested_topk(spark, sf):
    done = orders(spark, sf).filter("o_orderstatus = 'F'")
    out = find.nested(table(spark, sf, "customer").select("c_custkey"), "c_custkey", done, "o_custkey", ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "top")
    return out.select("c_custkey", F.array_join(F.transform("top", lambda x: x["o_orderkey"].cast("string")), ",").alias("top_orders"))


@query("SELECT c_custkey, count(o_orderkey) AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def nested_count_filtered(spark, sf):
    return find.child_count(table(spark, sf, "customer").select("c_custkey"), "c_custkey", orders(spark, sf), "o_custkey", "n_open", {"o_orderstatus": "O"})


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_name DESC, o_orderkey LIMIT 50")
def order_by_relation(spark, sf):
    joined = orders(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return find.find_many(joined, select=["o_orderkey", "c_name"], order_by=[{"c_name": "desc"}, {"o_orderkey": "asc"}], take=50)


@query("""SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM events) ORDER BY kind DESC NULLS FIRST, event_id ASC NULLS LAST LIMIT 300""")
def order_by_nulls(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return find.find_many(df, order_by=[{"kind": "desc"}, {"event_id": "asc"}], take=300)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def order_by_relcount(spark, sf):
    return find.find_many(orders(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n")), order_by=[{"n": "desc"}, {"o_custkey": "asc"}], take=20)


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority), o_orderkey LIMIT 40""")
def order_by_enum(spark, sf):
    return find.find_many(orders(spark, sf), select=["o_orderkey", "o_orderpriority"], order_by=[{"o_orderpriority": "asc"}, {"o_orderkey": "asc"}], take=40, enums={"o_orderpriority": PRIORITIES[::-1]})


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark, sf):
    return find.page(orders(spark, sf).select("o_orderkey", "o_orderdate"), [{"o_orderdate": "desc"}, {"o_orderkey": "asc"}], 3, 25)[0]


@query("""SELECT o_orderkey, bucket FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS bucket FROM orders)
 ORDER BY bucket, o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 30""")
def page_bucketed(spark, sf):
    bucket = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return find.find_many(orders(spark, sf).withColumn("bucket", bucket), select=["o_orderkey", "bucket"], order_by=[{"bucket": "asc"}, {"o_totalprice": "desc"}, {"o_orderkey": "asc"}], skip=30, take=30)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey >= 5) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def cursor_keyset(spark, sf):
    return find.find_many(orders(spark, sf), select=["o_orderkey", "o_totalprice"], order_by=[{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], cursor={"o_totalprice": 300000.0, "o_orderkey": 5}, take=20)


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15)")
def take_from_end(spark, sf):
    return find.find_many(orders(spark, sf), select=["o_orderkey"], order_by={"o_orderkey": "asc"}, take=-15)


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1")
def distinct_on(spark, sf):
    first = find.find_many(orders(spark, sf), order_by=[{"o_orderdate": "desc"}, {"o_orderkey": "asc"}], distinct=["o_custkey", "o_orderstatus"])
    return first.select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus <> 'F') AS large_open FROM orders")
def count_multi(spark, sf):
    return find.count_by(orders(spark, sf), total={}, done={"o_orderstatus": "F"}, large_open={"o_totalprice": {"gt": 100000}, "o_orderstatus": {"not": "F"}})


@query("""SELECT count(*) AS count_all, count(l_discount) AS count_l_discount, sum(l_linenumber) AS sum_l_linenumber, min(l_shipdate) AS min_l_shipdate, max(l_quantity) AS max_l_quantity
 FROM lineitem WHERE l_returnflag = 'A'""")
def aggregate_all(spark, sf):
    return find.aggregate(table(spark, sf, "lineitem"), {"l_returnflag": "A"}, count=["*", "l_discount"], sum=["l_linenumber"], min=["l_shipdate"], max=["l_quantity"])


@query("SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 8 AND NOT count(*) = 10")
def groupby_having(spark, sf):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return find.group_by(orders(spark, sf), ["o_custkey"], {"n": F.count("*"), "cents": cents}, {"o_orderstatus": {"not": "P"}}, {"n": {"gte": 8}, "NOT": {"n": 10}})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def find_unique_row(spark, sf):
    return find.find_unique(orders(spark, sf), {"o_orderkey": 77}, or_throw=True).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 12")
def rank_ordered_refetch(spark, sf):
    top = find.find_many(orders(spark, sf), select=["o_orderkey", "o_totalprice"], order_by=[{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], take=12)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("rows"))  # twelve rows
    ranked = ranked.select(F.posexplode("rows")).select(F.col("col.o_orderkey").alias("o_orderkey"), (F.col("pos") + 1).cast("bigint").alias("rank"))
    return find.in_rank_order(orders(spark, sf), "o_orderkey", ranked).select("o_orderkey", "rank")


@query("SELECT r_name, p_type FROM region CROSS JOIN (SELECT DISTINCT p_type FROM part)")
def dimension_product(spark, sf):
    """Two dimensions of a handful of rows each: the product is meant."""
    return table(spark, sf, "region").select("r_name").join(F.broadcast(table(spark, sf, "part").select("p_type").distinct()))


@query("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer WHERE c_nationkey = 3")
def omit_columns(spark, sf):
    return find.find_many(table(spark, sf, "customer"), {"c_nationkey": 3}, omit=["c_acctbal", "c_name"])


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
def raw_sql_bound(spark, sf):
    return spark.sql(
        "SELECT n_name, count(*) AS n FROM {customers} JOIN {nations} ON n_nationkey = c_nationkey WHERE c_acctbal > :least GROUP BY n_name",
        args={"least": 5000}, customers=table(spark, sf, "customer"), nations=table(spark, sf, "nation"),
    )
