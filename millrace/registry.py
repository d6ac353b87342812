"""The catalogue queries of the driver contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.scratch import table
from millrace.queries import Registry, algebra, analytics, auditing, curating, evidence, forms, linking, offering, shop, stores, texts

query = Registry()


@query("""
SELECT n_name, count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS revenue_cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' GROUP BY n_name
""")
def groupby_count(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("revenue_cents"))
    )


_PARTS = [query, algebra.query, analytics.query, texts.query, linking.query, curating.query, shop.query, evidence.query, auditing.query, forms.query, stores.query, offering.query]
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
