"""Rollups, periods, series, funnels, facets, windows, sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.operators import measure, rank
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()
NOW = datetime(2024, 1, 31)


def events(spark, sf):
    return table(spark, sf, "events")


@query("""
WITH c AS (SELECT nullif(user_id % 40, 7) AS who, event_type AS kind, 1 AS n FROM events),
k AS (SELECT who, kind, n, CASE WHEN who IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN CAST(who AS VARCHAR) ELSE 'unknown' END AS customer,
 CASE WHEN kind IN ('view', 'click') THEN kind ELSE 'unknown' END AS k FROM c)
SELECT 'customer' AS dimension, customer AS id, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL UNION ALL SELECT 'kind', k, CAST(sum(n) AS BIGINT) FROM k GROUP BY ALL""")
def rollup_unknown_bucket(spark, sf):
    counts = events(spark, sf).groupBy(F.nullif(F.col("user_id") % 40, F.lit(7)).alias("who"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([("view",), ("click",)], "kind string")
    customers = table(spark, sf, "customer").filter("c_mktsegment != 'BUILDING'")
    return measure.rollup_with_unknown(counts, "n", {"customer": (customers, "who", "c_custkey"), "kind": (kinds, "kind", "kind")})


@query("SELECT CAST(sum(CASE c_mktsegment WHEN 'BUILDING' THEN 19 WHEN 'MACHINERY' THEN 49 ELSE 0 END) AS BIGINT) AS mrr, CAST(12 * sum(CASE c_mktsegment WHEN 'BUILDING' THEN 19 WHEN 'MACHINERY' THEN 49 ELSE 0 END) AS BIGINT) AS mrr_yearly FROM customer")
def mrr_weighted_sum(spark, sf):
    return measure.weighted_sum(table(spark, sf, "customer"), "c_mktsegment", {"BUILDING": 19, "MACHINERY": 49}, "mrr")


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS other FROM orders GROUP BY 1""")
def status_pivot(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count_if(p == "1-URGENT").alias("urgent"), F.count_if(p == "2-HIGH").alias("high"), F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("other")
    )


@query("""
WITH n AS (SELECT count(*) AS viewed, count(*) FILTER (event_type IN ('click', 'purchase')) AS clicked, count(*) FILTER (event_type = 'purchase') AS bought FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT *, floor(clicked / viewed * 1000 + 0.5) / 10 AS clicked_of_viewed, floor(bought / clicked * 1000 + 0.5) / 10 AS bought_of_clicked FROM n""")
def funnel_ratio(spark, sf):
    kind = F.col("event_type")
    rows = events(spark, sf).filter(kind.isin("view", "click", "purchase"))
    return measure.funnel(rows, {"viewed": F.lit(True), "clicked": kind.isin("click", "purchase"), "bought": kind == "purchase"})


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT lower(trim(p_name)) AS value_key, arg_max(p_name, p_partkey) AS label, count(*) AS n, count(*) FILTER (p_size > 25) AS flagged FROM part GROUP BY 1 ORDER BY n DESC, flagged DESC, value_key LIMIT 10""")
def query_topn_representative(spark, sf):
    return measure.top_values(table(spark, sf, "part"), "p_name", "p_partkey", F.col("p_size") > 25, 10)


@query("""
WITH d(days) AS (VALUES (7), (14)), n AS (
 SELECT days, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - to_days(days) AND ts < TIMESTAMP '2024-01-31') AS current,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - to_days(2 * days) AND ts < TIMESTAMP '2024-01-31' - to_days(days)) AS previous FROM events CROSS JOIN d GROUP BY days)
SELECT days, current, previous, CASE WHEN previous > 0 THEN floor((current - previous) / previous * 1000 + 0.5) / 10 WHEN current = 0 THEN 0.0 END AS change FROM n""")
def period_over_period(spark, sf):
    return measure.period_over_period(events(spark, sf), "ts", NOW, [7, 14])


@query("""SELECT CAST(d AS DATE) AS day, count(event_id) FILTER (event_type = 'view') AS views, count(event_id) FILTER (event_type = 'click') AS clicks
 FROM generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY) AS s(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def daily_dense_series(spark, sf):
    kind = F.col("event_type")
    return measure.daily_series(events(spark, sf), "ts", NOW, 30, {"views": kind == "view", "clicks": kind == "click"})


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 ORDER BY clicks DESC, views DESC, user_id LIMIT 10""")
def two_stream_merge(spark, sf):
    kind = F.col("event_type")
    return measure.two_streams(events(spark, sf), "user_id", kind == "view", kind == "click", ("views", "clicks"), 10)


@query("SELECT coalesce(nullif(trim(nullif(event_type, 'error')), ''), 'Direct') AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, label LIMIT 8")
def source_breakdown(spark, sf):
    return measure.labelled_counts(events(spark, sf).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error"))), "event_type", "Direct", 8)


@query("SELECT lower(replace(p_type, ' ', '-')) AS facet, count(DISTINCT p_brand) AS n FROM part GROUP BY 1")
def facet_counts(spark, sf):
    return measure.facet_counts(table(spark, sf, "part"), text.slugify(F.col("p_type")), "p_brand")


@query("SELECT n_regionkey, count(*) AS n, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_collect(spark, sf):
    return measure.collected(table(spark, sf, "nation"), "n_regionkey", {"names": F.col("n_name")})


@query("SELECT text AS value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_values(spark, sf):
    return measure.duplicate_values(table(spark, sf, "documents"), "text")


@query("""
WITH g AS (SELECT event_type, count(*) AS shown, count(*) FILTER (value > 20) AS clicked FROM events GROUP BY 1)
SELECT event_type, shown, clicked, floor(clicked / shown * 10000 + 0.5) / 100 AS ctr, floor(clicked / (SELECT sum(clicked) FROM g) * 1000 + 0.5) / 10 AS share FROM g""")
def ctr_share(spark, sf):
    rows = events(spark, sf).select("event_type", F.lit(1).alias("shown"), (F.col("value") > 20).cast("int").alias("clicked"))
    return measure.click_through(rows, ["event_type"], "shown", "clicked")


@query("""
WITH b(bucket) AS (VALUES ('90-100'), ('80-89'), ('60-79'), ('<60'), ('none'))
SELECT bucket, count(p_partkey) AS n FROM b LEFT JOIN part ON bucket = CASE WHEN p_size * 2 >= 90 THEN '90-100' WHEN p_size * 2 >= 80 THEN '80-89' WHEN p_size * 2 >= 60 THEN '60-79' ELSE '<60' END GROUP BY 1""")
def score_bands(spark, sf):
    score = F.col("p_size") * 2
    band = F.when(score >= 90, "90-100").when(score >= 80, "80-89").when(score >= 60, "60-79").otherwise("<60")
    return measure.bucket_counts(table(spark, sf, "part"), band, ["90-100", "80-89", "60-79", "<60", "none"])


@query("SELECT c_mktsegment, CAST(floor(avg(c_acctbal) + 0.5) AS BIGINT) AS average, floor(count(*) FILTER (c_acctbal > 0) / count(*) * 1000 + 0.5) / 10 AS ready FROM customer GROUP BY 1")
def average_and_ready(spark, sf):
    ready = numbers.percent(F.count_if(F.col("c_acctbal") > 0), F.count("*"))
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(numbers.round_half_up(F.avg("c_acctbal")).alias("average"), ready.alias("ready"))


@query("SELECT CAST(sum(round(o_totalprice * 100)) FILTER (o_orderstatus = 'F') AS BIGINT) AS paid_cents FROM orders")
def filtered_sum(spark, sf):
    return table(spark, sf, "orders").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice") * 100))).cast("bigint").alias("paid_cents"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    return rank.latest_per_key(events(spark, sf), ["user_id"], "ts", columns=["event_type"])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def topk_per_parent(spark, sf):
    from millrace.operators.find import top_per_parent

    rows = top_per_parent(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 2)
    return rows.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_per_key(spark, sf):
    return rank.first_per_key(table(spark, sf, "documents").select("text", "doc_id"), ["text"], [F.col("doc_id")])


@query("""SELECT p_partkey, row_number() OVER w = 1 AS keep, first_value(p_partkey) OVER w AS keep_id FROM part WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def keeper_losers(spark, sf):
    rows = rank.keepers(table(spark, sf, "part"), ["p_name", "p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey")
    return rows.select("p_partkey", "keep", "keep_id")


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority DESC) AS k FROM c)
SELECT o_custkey, max(o_orderpriority) FILTER (k = 1) AS winner, max(n) FILTER (k = 1) AS top, coalesce(max(n) FILTER (k = 2), 0) AS second,
 max(n) FILTER (k = 1) >= 4 AND max(n) FILTER (k = 1) - coalesce(max(n) FILTER (k = 2), 0) >= 2 AS decided FROM r GROUP BY 1""")
def winner_margin(spark, sf):
    votes = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return rank.winner_margin(votes, "o_custkey", "o_orderpriority", "n", 4, 2)


@query("""SELECT event_id, CASE WHEN lag(event_type) OVER w IS NULL THEN 'NEW' WHEN lag(event_type) OVER w = event_type THEN 'SAME' ELSE 'CHANGED' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def hash_change_state(spark, sf):
    return rank.hash_changes(events(spark, sf), "user_id", "ts", "event_type").select("event_id", "state")


@query("""
WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events QUALIFY k <= 12),
f AS (SELECT user_id, k, t AS last, 1 AS n FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.k, CASE WHEN n < 3 AND last - t >= 21600000000 THEN t ELSE last END, CASE WHEN n < 3 AND last - t >= 21600000000 THEN n + 1 ELSE n END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id, max(n) AS n FROM f GROUP BY 1""")
def spaced_selection(spark, sf):
    return rank.spaced_selection(events(spark, sf), "user_id", "ts", 6 * 3600).select("user_id", F.size("kept").alias("n"))


@query("""
WITH r AS (SELECT p_partkey, replace(p_name, ' ', '-') || CASE p_size % 10 WHEN 0 THEN '-2' WHEN 1 THEN '-3' ELSE '' END AS slug FROM part),
t AS (SELECT replace(p_name, ' ', '-') || '-2' AS slug FROM part WHERE p_brand = 'Brand#1' UNION SELECT replace(p_name, ' ', '-') FROM part WHERE p_brand = 'Brand#2'),
u AS (SELECT slug FROM r UNION SELECT slug FROM t),
k AS (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) + CASE WHEN slug IN (SELECT slug FROM t) THEN 1 ELSE 0 END AS k FROM r),
x AS (SELECT slug, unnest(range(2, 12 + max(k))) AS x FROM k GROUP BY slug),
f AS (SELECT slug, x, row_number() OVER (PARTITION BY slug ORDER BY x) AS i FROM x WHERE slug || '-' || CAST(x AS VARCHAR) NOT IN (SELECT slug FROM u))
SELECT p_partkey, CASE WHEN k = 1 THEN k.slug ELSE k.slug || '-' || CAST(x AS VARCHAR) END AS unique_slug FROM k LEFT JOIN f ON f.slug = k.slug AND i = k - 1""")
def numbered_slugs(spark, sf):
    part = table(spark, sf, "part")
    slug = text.slugify(F.col("p_name"))
    end = F.when(F.col("p_size") % 10 == 0, "-2").when(F.col("p_size") % 10 == 1, "-3").otherwise("")
    second = part.filter("p_brand = 'Brand#1'").select(F.concat(slug, F.lit("-2")).alias("slug"))
    taken = second.unionByName(part.filter("p_brand = 'Brand#2'").select(slug.alias("slug")))
    return rank.numbered_slugs(part.select("p_partkey", F.concat(slug, end).alias("slug")), "slug", [F.col("p_partkey")], taken).select("p_partkey", "unique_slug")


@query("""SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(0.6 AS DOUBLE) AS priority FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, CAST(0.8 AS DOUBLE) FROM region
 UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def union_sitemap(spark, sf):
    part = lambda kind, i, name, p: table(spark, sf, kind).select(F.lit(kind).alias("kind"), F.col(i).cast("bigint").alias("id"), F.col(name).alias("name"), *([F.lit(p).alias("priority")] if p else []))
    return measure.union_entities([part("nation", "n_nationkey", "n_name", 0.6), part("region", "r_regionkey", "r_name", 0.8), part("supplier", "s_suppkey", "s_name", None)])


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf):
    used = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left_anti").distinct()


@query("SELECT c_custkey, 'left' AS side FROM customer WHERE c_custkey % 10 = 3")
def reconcile_sets(spark, sf):
    all_keys = table(spark, sf, "customer").select("c_custkey")
    return measure.reconcile(all_keys, all_keys.filter("c_custkey % 10 != 3"))


@query("""
WITH b AS (SELECT p_brand, list_distinct(list(p_name)) AS types FROM part GROUP BY 1)
SELECT a.p_brand AS a, b.p_brand AS b, len(list_intersect(a.types, b.types)) / len(list_distinct(list_concat(a.types, b.types))) AS jaccard,
 len(list_intersect(a.types, b.types)) / least(len(a.types), len(b.types)) AS overlap FROM b AS a JOIN b ON a.p_brand < b.p_brand""")
def jaccard_tokens(spark, sf):
    """All pairs of the 25 brands: the set is fixed by the catalogue."""
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("types"))
    a, b = (brands.select(F.col("p_brand").alias(x), F.col("types").alias(f"t{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", text.token_overlap(F.col("ta"), F.col("tb")).alias("jaccard"), text.token_overlap(F.col("ta"), F.col("tb"), "coefficient").alias("overlap"))


@query("""
WITH l AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS list FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY list, p_partkey) > 1 AS again FROM l)
SELECT p_partkey, p_brand, p_partkey AS place FROM t ORDER BY again, list, p_partkey LIMIT 9""")
def merge_ranked_lists(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("place"))
    return rank.merge_ranked(parts.filter("p_size > 40"), parts.filter("p_size <= 40"), "p_partkey", "p_brand", "place", 9)


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_type, event_id, t, k, t AS last, true AS ok FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.event_type, s.event_id, s.t, s.k, CASE WHEN s.t - f.last > 7200000000 THEN s.t ELSE f.last END, s.t - f.last > 7200000000
 FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.k = f.k + 1)
SELECT event_id, user_id, event_type FROM f WHERE ok""")
def view_accept_window(spark, sf):
    return rank.accepted(events(spark, sf), ["user_id", "event_type"], "ts", "event_id", 7200).select("event_id", "user_id", "event_type")


@query("""
WITH c AS (SELECT p_brand, p_partkey, 'https://a.example/' || p_name AS url, p_size % 3 = 0 AS ok FROM part WHERE p_size % 5 <> 1 UNION ALL SELECT p_brand, p_partkey, 'ftp://a.example/x', true FROM part WHERE p_size % 5 = 1)
SELECT p_brand, count(*) FILTER (ok) AS verified_count, count(DISTINCT url) FILTER (ok AND starts_with(url, 'http')) AS official_count, (SELECT count(DISTINCT p_type) FROM part p WHERE p.p_brand = c.p_brand) AS topics FROM c GROUP BY 1""")
def owner_profiles(spark, sf):
    part, odd = table(spark, sf, "part"), F.col("p_size") % 5 == 1
    cards = part.select("p_brand", "p_partkey", F.when(odd, "ftp://a.example/x").otherwise(F.concat(F.lit("https://a.example/"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("url"), (odd | (F.col("p_size") % 3 == 0)).alias("ok"))
    return measure.owner_profiles(cards, "p_brand", "p_partkey", F.col("ok"), "url", part.select("p_brand", F.col("p_type").alias("slug")))


@query("""
WITH m AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS alt FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS media_count, count(n) AS with_media, count(*) - count(n) AS missing_media, count(*) FILTER (alt = 0) AS missing_alt FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def media_summary(spark, sf):
    media = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "text").otherwise("").alias("alt"))
    return measure.media_summary(table(spark, sf, "customer"), media, "c_custkey", "alt")


@query("""SELECT q AS queue, c_custkey FROM customer, (VALUES ('debt'), ('rich'), ('far')) AS v(q)
 WHERE (q = 'debt' AND c_acctbal < 0) OR (q = 'rich' AND c_acctbal > 9000) OR (q = 'far' AND c_nationkey > 20)""")
def remediation_queues(spark, sf):
    return measure.remediation_queues(table(spark, sf, "customer"), "c_custkey", [("debt", F.col("c_acctbal") < 0), ("rich", F.col("c_acctbal") > 9000), ("far", F.col("c_nationkey") > 20)])


@query("""SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS utc, CAST(date_trunc('month', ts + INTERVAL 2 HOUR) - INTERVAL 2 HOUR AS TIMESTAMP) AS athens,
 CAST(ts AS DATE) - 9 AS start, CAST(ts AS DATE) - 3 AS "end", CAST(ts AS DATE) - 16 AS before_start, CAST(ts AS DATE) - 10 AS before_end FROM events""")
def months_and_windows(spark, sf):
    ts = F.col("ts").cast("timestamp")
    months = [numbers.month_start(ts, zone).cast("timestamp_ntz").alias(name) for zone, name in (("UTC", "utc"), ("Europe/Athens", "athens"))]
    return events(spark, sf).select("event_id", *months, numbers.reporting_windows(ts, 7, 3).alias("w")).select("event_id", "utc", "athens", "w.*")


WORDS = ["άλφα", "Άλφα", "αλφάβητο", "Ωμέγα", "ψάρι", "beta", "Alpha", "zeta", "alpha"]


@query("""SELECT p_partkey, w AS word FROM (SELECT p_partkey, ['άλφα', 'Άλφα', 'αλφάβητο', 'Ωμέγα', 'ψάρι', 'beta', 'Alpha', 'zeta', 'alpha'][CAST(p_size % 9 AS INT) + 1] AS w FROM part) ORDER BY w COLLATE el, p_partkey LIMIT 90""")
def order_collated(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("p_size") % 9 + 1).cast("int")).alias("word"))
    return rows.orderBy(text.collated(F.col("word")), "p_partkey").limit(90)
