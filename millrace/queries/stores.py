"""Queries that write to the shared folder and read back, change tables, and work through streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import panes
from millrace.plans import changes, scratch
from millrace.plans.catalog import Catalog, ForeignKey
from millrace.plans.changes import Plan
from millrace.plans.scratch import table
from millrace.plans.stored import StoredTable
from millrace.queries import Registry
from millrace.sources import files
from millrace.streaming import replay, views

query = Registry()


def _folder(spark, name):
    path = f"{scratch.shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    scratch.remember(path)
    return path


@query("""SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' || chr(10) || 'second line' AS note FROM customer""")
def csv_round_trip(spark, sf):
    """Cells with commas, quotes and line breaks, written with a byte order mark and read again."""
    path = _folder(spark, "csv")
    note = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nsecond line'))
    files.write_csv(table(spark, sf, "customer").select("c_custkey", note.alias("note")), path, mark=True)
    return files.read_csv(spark, path, "c_custkey long, note string", multi_line=True)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 1")
def plain_csv_first(spark, sf):
    """Lines split at each comma, each region's first one."""
    path = _folder(spark, "lines")
    rows = table(spark, sf, "nation").orderBy("n_nationkey").select(F.concat_ws(" , ", "n_regionkey", "n_name", "n_nationkey").alias("value"))
    spark.createDataFrame([("region,name,key",), ("  ",)], "value string").union(rows).coalesce(1).write.text(path)
    return files.read_plain_csv(spark, path, ["region", "name", "key"], first_by="region").select("region", "name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def json_folder(spark, sf):
    """A folder of JSON arrays, a file for each region, one of which is broken."""
    path = _folder(spark, "json")
    arrays = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    spoilt = arrays.withColumn("value", F.when(F.col("n_regionkey") == 1, F.substring("value", 1, 20)).otherwise(F.col("value")))
    spoilt.write.partitionBy("n_regionkey").text(path)
    return files.read_folder(spark, path, "n_nationkey int, n_name string", "n_nationkey", pattern="*.txt", named=r"^part-").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name, n_regionkey = 1 AS broken FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT NULL, NULL, 1)")
def json_quarantine(spark, sf):
    """The same with what can't be read kept beside it, a row for each."""
    path = _folder(spark, "json")
    arrays = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    spoilt = arrays.withColumn("value", F.when(F.col("n_regionkey") == 1, F.substring("value", 1, 20)).otherwise(F.col("value")))
    spoilt.write.partitionBy("n_regionkey").text(path)
    rows, bad = files.read_quarantined(spark, path, "n_nationkey int, n_name string", "*.txt")
    bad = bad.select(F.lit(None).cast("int").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name"), F.lit(True).alias("broken"))
    return rows.select("n_nationkey", "n_name", F.lit(False).alias("broken")).unionByName(bad)


@query("SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS region FROM nation")
def json_array_rows(spark, sf):
    """One JSON document with its rows under a key."""
    path = _folder(spark, "rows")
    region = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("region")
    whole = table(spark, sf, "nation").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), region)).alias("rows"))  # 25 rows by design
    whole.coalesce(1).write.json(path)
    return files.read_json_rows(spark, path, "name string, region int", rows="rows")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def state_log(spark, sf):
    """A log that is appended to twice; each user's last entry."""
    path = _folder(spark, "log")
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    files.append_state(events.filter("event_type != 'view'"), path)
    files.append_state(events.filter("event_type = 'view'"), path)
    return files.read_state(spark, path, "user_id long, event_id long, event_type string", "user_id", "event_id")


@query("SELECT DISTINCT 'https://e.example/' || lower(n_name) AS url FROM nation")
def sitemap_pages(spark, sf):
    """Pages that an index of sitemaps leads to, by way of one for each region."""
    nation = table(spark, sf, "nation")
    entry = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit("</loc></url>"))
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xml"))
    maps = nation.groupBy(region.alias("url")).agg(F.concat_ws("", F.collect_list(entry(F.concat(F.lit("https://e.example/"), F.lower("n_name"))))).alias("xml"))
    root = nation.select(region.alias("r")).distinct().agg(F.concat(F.lit("<sitemapindex>"), F.concat_ws("", F.collect_list(entry(F.col("r"))))).alias("xml")).select(F.lit("root.xml").alias("url"), "xml")
    return files.walk_sitemaps(maps.unionByName(root), spark.createDataFrame([("root.xml",)], "url string"))


@query("SELECT p_type, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS large FROM part GROUP BY 1")
def bucket_files(spark, sf):
    """A folder for each type, counted when written and when read again."""
    path = _folder(spark, "buckets")
    counted = files.write_buckets(table(spark, sf, "part").select("p_type", "p_size"), path, "p_type")
    again = spark.read.parquet(path).groupBy("p_type").agg(F.sum(F.when(F.col("p_size") > 25, 1).otherwise(0)).alias("large"))
    return counted.withColumnRenamed("count", "n").join(again, "p_type")


@query("SELECT p_type, count(*) AS n, (SELECT count(*) FROM part) AS rows FROM part GROUP BY 1")
def report_files(spark, sf):
    """Rows and their summary as JSON, side by side, read again."""
    path, rows = _folder(spark, "report"), table(spark, sf, "part").select("p_partkey", "p_type")
    files.write_report(rows, path, rows.groupBy("p_type").agg(F.count("*").alias("n")))
    total = spark.read.schema("p_partkey long").json(f"{path}/rows").agg(F.count("*").alias("rows"))
    return spark.read.schema("p_type string, n long").json(f"{path}/summary").join(F.broadcast(total))


@query("""
WITH i AS (SELECT p_brand, 'BRAND_' || p_type AS code FROM part WHERE p_size < 5), t AS (SELECT code, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, code LIMIT 3)
SELECT '| ' || code || ' | ' || n || ' |' AS line FROM t UNION ALL SELECT '# Audit' UNION ALL SELECT '- issues: ' || count(*) FROM i UNION ALL SELECT '| ' || p_brand || ' | ' || code || ' |' FROM (FROM i ORDER BY p_brand, code LIMIT 2)""")
def markdown_lines(spark, sf):
    """A report's lines: title, total, the three most frequent codes, the first two issues."""
    issues = table(spark, sf, "part").filter("p_size < 5").select("p_brand", F.concat(F.lit("BRAND_"), "p_type").alias("code"))
    report = files.markdown_report("Audit", {"issues": issues.count()}, issues.groupBy("code").agg(F.count("*").alias("n")), issues, top_codes=3, first_issues=2)
    lines = spark.createDataFrame([(x,) for x in report.split("\n")], "line string")
    return lines.filter("line != '' and line not like '|-%' and line not in ('| code | n |', '| p_brand | code |')")


@query("SELECT row_number() OVER (ORDER BY min(doc_id)) AS place, source AS value FROM documents WHERE source IS NOT NULL GROUP BY source")
def distinct_text(spark, sf):
    """Distinct values, a line for each, in the order in which they come first."""
    path = _folder(spark, "text")
    files.write_distinct_text(table(spark, sf, "documents").filter("source is not null"), "source", path, by="doc_id")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("place", "value")).select((F.col("place") + 1).cast("bigint").alias("place"), "value")


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'NEW', c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING')
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM a WHERE NOT c_acctbal > 9000""")
def change_rows(spark, sf):
    """Rows inserted unless their key is there, updated, and deleted."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = customer.filter("c_acctbal > 5000").withColumn("c_mktsegment", F.lit("NEW"))
    rows = changes.insert(customer.filter("c_mktsegment = 'BUILDING'"), new.union(new), ["c_custkey"], skip_duplicates=True)
    rows = changes.update(rows, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT")})
    return changes.delete(rows, F.col("c_acctbal") > 9000)


@query("""SELECT n_nationkey, CAST(CASE WHEN n_regionkey < 3 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) ELSE 0 END AS BIGINT) AS n FROM nation""")
def increment_counts(spark, sf):
    """Counters that grow by what came in, where a guard allows it."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.lit(0).cast("bigint").alias("n"))
    seen = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(1).alias("amount"))
    return changes.increment(rows, "n_nationkey", seen, "amount", "n", F.col("n_regionkey") < 3).select("n_nationkey", "n")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN c_nationkey - 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def merge_losers(spark, sf):
    """Children of merged nations, pointed to the ones that stay."""
    mapping = table(spark, sf, "nation").filter("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("loser"), (F.col("n_nationkey") - 1).alias("winner"))
    return changes.merge_entities(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", mapping)


@query("""
WITH r AS (SELECT r_regionkey FROM region WHERE r_regionkey IN (0, 3)), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (FROM r)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (FROM o)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
x AS (SELECT 1 FROM lineitem WHERE l_suppkey IN (FROM s) AND l_orderkey NOT IN (FROM o))
SELECT 'region' AS "table", (SELECT count(*) FROM r) AS deleted, 0 AS emptied UNION ALL SELECT 'nation', (SELECT count(*) FROM n), 0 UNION ALL SELECT 'customer', (SELECT count(*) FROM c), 0
UNION ALL SELECT 'orders', (SELECT count(*) FROM o), 0 UNION ALL SELECT 'supplier', (SELECT count(*) FROM s), 0 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM x)""")
def cascade_all(spark, sf):
    """What goes with two regions: nations, customers, orders, lines; lines of lost suppliers stay without one."""
    keys = [
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", on_delete="set null"),
    ]
    catalog = Catalog({n: table(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}, keys)
    return catalog.deletion_counts("region", table(spark, sf, "region").filter("r_regionkey in (0, 3)"))


@query("""
SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0 AND event_type NOT IN ('error', 'view')""")
def click_stream(spark, sf):
    """Clicks that a person made, of active customers, from a folder of event files that are worked through slice by slice."""
    source, out, checkpoint = (_folder(spark, f"clicks-{x}") for x in ("in", "out", "checkpoint"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    files = replay.write_in_order(events, "ts", source, 3)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
    kind = F.col("event_type")
    clicks = views.human_clicks(stream, F.when(kind == "error", "head").otherwise("GET"), F.when(kind == "view", "Prefetch;prerender"))
    active = table(spark, sf, "customer").filter("c_acctbal > 0")
    replay.run_available(views.only_active(clicks, active, "user_id", "c_custkey").select("event_id", "user_id"), out, checkpoint)
    return replay.read_batches(spark, out, "event_id long, user_id long")


@query("""
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), w(days) AS (VALUES (3), (7)),
n AS (SELECT day, days, event_type, count(*) FILTER (CAST(ts AS DATE) > day - CAST(days AS INT)) AS current, count(*) FILTER (CAST(ts AS DATE) <= day - CAST(days AS INT)) AS previous
 FROM d, w, events WHERE CAST(ts AS DATE) <= day AND CAST(ts AS DATE) > day - CAST(2 * days AS INT) GROUP BY ALL)
SELECT day, days, event_type, current, previous FROM n""")
def rolling_periods(spark, sf):
    """Figures of the last days and of as many before them, for every day, each from the day before it and a few panes."""
    path = _folder(spark, "panes")
    panes.write_panes(table(spark, sf, "events"), "ts", ["event_type"], path)
    return panes.rolling(spark, path, ["event_type"], "2024-01-10", "2024-01-31", [3, 7])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 250000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 250000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def stored_apply(spark, sf):
    """A plan applied to a stored table, twice: rows change, some move to another partition, the second time is nothing."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = StoredTable.create(orders, _folder(spark, "stored"), ["o_orderkey"], "o_orderstatus")
    actions = orders.filter("o_orderstatus = 'P' and o_totalprice < 250000").select("o_orderkey", F.lit("F").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    plan = Plan(actions, stored.read(), ["o_orderkey"])
    stored.apply(plan)
    stored.apply(plan)
    return StoredTable(spark, stored.root).read()
