"""Evidence: mentions of many names, brand coverage, offers in pages, event logs that are worked through run by run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import aliases
from millrace.plans import scratch
from millrace.plans.scratch import table
from millrace.queries import Registry
from millrace.sources import offers
from millrace.streaming import replay

query = Registry()


def _folder(spark, name):
    path = f"{scratch.shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    scratch.remember(path)
    return path


#: Words of a text in catalogue form, as SQL.
FORM = r"trim(regexp_replace(replace(lower(strip_accents({})), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"""
WITH n AS (SELECT item_id, unnest([array_to_string(w[1:2], ' '), array_to_string(w[4:6], ' '), w[9]]) AS alias FROM (SELECT item_id, string_split({FORM.format('text')}, ' ') AS w FROM benchmark)),
d AS (SELECT doc_id, ' ' || {FORM.format("coalesce(text, '')")} || ' ' AS form FROM documents)
SELECT DISTINCT doc_id, item_id FROM d JOIN n ON alias <> '' AND contains(form, ' ' || alias || ' ')""")
def alias_mentions(spark, sf):
    """Which documents mention one of some names of each benchmark item: its first words, three later ones, and one."""
    from millrace.functions.text import catalog_form

    words = F.split(catalog_form(F.col("text")), " ")
    run = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    names = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(run(1, 2), run(4, 3), run(9, 1))).alias("alias"))
    return aliases.mentions(table(spark, sf, "documents"), "doc_id", "text", names, "item_id", "alias").select("doc_id", "item_id")


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal > 7000 THEN n_name || ' Store' WHEN s_acctbal > 4000 THEN lower(n_name) ELSE s_name END AS name,
  CASE WHEN s_acctbal < 2000 THEN 'https://www.shop.' || replace(lower(n_name), '_', '-') || '.example/x' WHEN s_acctbal < 3000 THEN 'https://other.example' END AS url FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 4),
m AS (SELECT DISTINCT n_nationkey, s_suppkey FROM nation, s WHERE lower(name) IN (lower(n_name), lower(n_name) || ' store') OR url = 'https://www.shop.' || replace(lower(n_name), '_', '-') || '.example/x'),
c AS (SELECT l_suppkey, count(*) AS cards, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 49) AS active, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 49 AND l_discount > 0.09) AS verified FROM lineitem GROUP BY 1),
t AS (SELECT n_nationkey, count(s_suppkey) AS shops, CAST(coalesce(sum(cards), 0) AS BIGINT) AS cards, CAST(coalesce(sum(active), 0) AS BIGINT) AS active, coalesce(sum(verified), 0) AS verified FROM nation LEFT JOIN m USING (n_nationkey) LEFT JOIN c ON l_suppkey = s_suppkey GROUP BY 1)
SELECT n_nationkey, shops, cards, active, CASE WHEN verified > 0 THEN 'ACTIVE_VERIFIED_CARD_PRESENT' WHEN active > 0 THEN 'ACTIVE_CARD_PRESENT' WHEN shops > 0 THEN 'MERCHANT_ONLY' ELSE 'MISSING_MERCHANT' END AS classification FROM t""")
def brand_coverage(spark, sf):
    """Coverage of nations as brands by suppliers as shops: by two names, or a domain."""
    nation = table(spark, sf, "nation")
    low, balance = F.lower("n_name"), F.col("s_acctbal")
    sellers = table(spark, sf, "supplier").join(F.broadcast(nation.filter("n_regionkey < 4")), F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.when(balance > 7000, F.concat("n_name", F.lit(" Store"))).when(balance > 4000, low).otherwise(F.col("s_name"))
    site = F.concat(F.replace(low, F.lit("_"), F.lit("-")), F.lit(".example"))
    url = F.when(balance < 2000, F.concat(F.lit("https://www.shop."), site, F.lit("/x"))).when(balance < 3000, F.lit("https://other.example"))
    shops = sellers.select("s_suppkey", name.alias("name"), url.alias("url"))
    names = nation.select("n_nationkey", F.explode(F.array("n_name", F.concat("n_name", F.lit(" store")))).alias("alias"))
    domains = nation.select("n_nationkey", site.alias("domain"))
    cards = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    active = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 49)
    return aliases.brand_coverage(nation, "n_nationkey", names, "alias", domains, "domain", shops, "s_suppkey", "name", "url", cards, active, F.col("l_discount") > 0.09)


@query("""
WITH p AS (SELECT p_partkey, p_name, p_retailprice AS price, p_size FROM part WHERE p_size % 10 <> 7)
SELECT p_partkey, 'name' AS kind, 'name' AS source, p_name AS name, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS currency FROM p
UNION ALL SELECT p_partkey, 'price', 'JSONLD_PRICE', NULL, CAST(price AS DOUBLE), CASE WHEN p_size < 25 THEN 'EUR' ELSE 'GBP' END FROM p
UNION ALL SELECT p_partkey, 'price', 'JSONLD_LOWPRICE', NULL, p_size * 1000.0, CASE WHEN p_size < 25 THEN 'EUR' ELSE 'GBP' END FROM p WHERE p_size <= 10
UNION ALL SELECT p_partkey, 'price', 'JSONLD_HIGHPRICE', NULL, p_size + 0.5, 'USD' FROM p WHERE p_size + 0.5 >= 5""")
def json_ld_offers(spark, sf):
    """Offers in pages made of parts: prices as numbers and texts, the currency of the object around, another inside, and bad JSON."""
    size, dollars = F.col("p_size"), F.concat(F.col("p_size").cast("string"), F.lit(",50 $"))
    inner = F.struct(F.concat((size * 1000).cast("string"), F.lit(" eur")).alias("lowPrice"), F.array(F.struct(F.lit("usd").alias("priceCurrency"), dollars.alias("highPrice"))).alias("offers"))
    offer = F.struct(F.when(size < 25, "€").otherwise("gbp").alias("priceCurrency"), F.col("p_retailprice").cast("double").alias("price"), F.array(inner).alias("itemOffered"))
    block = F.to_json(F.struct(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), offer.alias("offers")))
    spoilt = F.when(size % 10 == 7, F.substring(block, 1, 40)).otherwise(block)
    html = F.concat(F.lit('<html><script type="application/ld+json">'), spoilt, F.lit("</script><p>text</p></html>"))
    return offers.page_offers(table(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_type, event_id, t, k, t AS last, true AS ok FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.event_type, s.event_id, s.t, s.k, CASE WHEN s.t - f.last > 7200000000 THEN s.t ELSE f.last END, s.t - f.last > 7200000000
 FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.k = f.k + 1)
SELECT event_id, user_id, event_type FROM f WHERE ok""")
def view_stream(spark, sf):
    """The views that count, from a folder of event files worked through in two runs: the second goes on where the first ended."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source, out, checkpoint = (_folder(spark, f"views-{x}") for x in ("in", "out", "checkpoint"))
    half = events.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [0.5], 0.001)
    late = F.unix_micros("ts") >= (half[0] if half else 0)
    schema = "user_id long, event_type string, ts timestamp, event_id long"
    rows = events.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
    for part in (rows.filter(~late), rows.filter(late)):
        files = replay.write_in_order(part, "ts", source, 1)  # without an order of their own, so a run takes them in one batch
        found = replay.count_views(spark, source, schema, ["user_id", "event_type"], "ts", out, checkpoint, 7200, files)
    counted = found.join(rows, ["user_id", "event_type", "ts"])  # of events at one time, the first
    return counted.groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")
