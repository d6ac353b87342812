"""Programs of items in several amounts, pages that are verified by their evidence, tiers of subscriptions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import curation, linkage, programs, verify
from millrace.operators.rank import first_per_key
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()

#: Parts with the words of what they are, and of two more texts, and amounts that some lack, as SQL.
PARTS = """p AS (SELECT p_partkey AS id, p_brand AS block, list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' s' || CAST(p_size // 5 AS VARCHAR), ' '))) AS w,
 list_sort(list_distinct(string_split(p_name || ' ' || CAST(p_size AS VARCHAR), ' '))) AS v, CASE WHEN p_size < 45 THEN list_sort(list_distinct([p_size % 3, p_size % 2])) END AS am FROM part)"""


def _parts(spark, sf):
    size = F.col("p_size")
    band = F.concat(F.lit("s"), F.floor(size / 5).cast("string"))
    amounts = F.when(size < 45, F.array(size % 3, size % 2))
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type", band).alias("w"), F.concat_ws(" ", "p_name", size.cast("string")).alias("v"), amounts.alias("am"))


@query(f"""
WITH {PARTS}, c AS (SELECT block, w, min(id) AS k FROM p GROUP BY ALL)
SELECT a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) AS shared, greatest(len(a.w), len(b.w)) AS larger FROM c a JOIN c b ON a.block = b.block AND a.k < b.k
WHERE 100 * len(list_intersect(a.w, b.w)) >= 72 * greatest(len(a.w), len(b.w))""")
def alike_words(spark, sf):
    """Classes of parts of a brand whose words are alike; copies are one class."""
    _, links = programs.alike_sets(_parts(spark, sf), "p_partkey", "p_brand", "w")
    return links.select("a", "b", F.col("shared").cast("bigint").alias("shared"), F.col("larger").cast("bigint").alias("larger"))


@query(f"""
WITH RECURSIVE {PARTS},
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.block = b.block AND a.id <> b.id WHERE len(a.am) > 0 AND len(b.am) > 0 AND a.am <> b.am
 AND (100 * len(list_intersect(a.w, b.w)) >= 72 * greatest(len(a.w), len(b.w)) OR 100 * len(list_intersect(a.v, b.v)) >= 72 * greatest(len(a.v), len(b.v)))),
r AS (SELECT a AS id, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id, min(g) AS program FROM r GROUP BY id""")
def program_groups(spark, sf):
    """Parts of a brand that hang together by words and differ in their amounts."""
    return programs.programs(_parts(spark, sf), "p_partkey", "p_brand", "am", ["w", "v"])


#: What pages are asked for: words of some languages, one of them in the address; signs of a purchase in text and markup.
SIGNS = verify.Signs(meant=r"(^| )(of|for) |/en/", aside=r"/(en|fr)/[0-9]*7", bought=r"\$\$\$|%%%| anat ", marked=r"<div class=.ad.>[A-H]")


@query(r"""
WITH u AS (SELECT page_id, html, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages),
t AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS site, CASE WHEN starts_with(host, 'blog.') THEN 'writers.example' ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS shop, contains(url, 'utm_source') AS lost, CASE WHEN starts_with(url, 'http:') AND contains(url, '/de/') THEN 404 ELSE 200 END AS status,
 CASE WHEN ends_with(url, '#top') THEN 'other.example' ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS final, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS address,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\s+', ' ', 'g')) AS body,
 regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g') AS title, regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g') AS h1 FROM u),
s AS (SELECT *, regexp_matches(lower(strip_accents(trim(title))), '(^| )(of|for) ') AS in_title, regexp_matches(lower(strip_accents(trim(h1))), '(^| )(of|for) ') AS in_heading,
 regexp_matches(address, '/en/') AS in_url, regexp_matches(lower(strip_accents(body)), '(^| )(of|for) ') AS in_text, regexp_matches(lower(strip_accents(trim(title))), '(^| )(of|for) ') AS named,
 regexp_matches(lower(strip_accents(title || ' ' || h1 || ' ' || body)), '\$\$\$|%%%| anat ') AS bought, regexp_matches(html, '<div class=.ad.>[A-H]') AS marked, contains(title || ' ' || h1 || ' ' || body, n) AS found FROM t)
SELECT page_id, n AS amount, CASE WHEN lost OR status <> 200 THEN 'ERROR' WHEN site <> shop OR final <> shop THEN 'REVIEW' WHEN regexp_matches(address, '/(en|fr)/[0-9]*7') AND NOT in_title AND NOT in_heading THEN 'REVIEW'
 WHEN NOT (in_title OR in_heading OR in_url AND (in_text OR named)) OR NOT (bought OR marked OR found) THEN 'REVIEW' ELSE 'AUTO_SAFE' END AS bucket,
 CASE WHEN lost THEN 'FETCH_ERROR:TimeoutError' WHEN status <> 200 THEN 'HTTP_404' WHEN site <> shop THEN 'OFFICIAL_URL_MERCHANT_DOMAIN_MISMATCH' WHEN final <> shop THEN 'REDIRECT_DOMAIN_MISMATCH'
 WHEN regexp_matches(address, '/(en|fr)/[0-9]*7') AND NOT in_title AND NOT in_heading THEN 'TERMS_PRIVACY_GIFTSET_OR_SUPPORT_PAGE' WHEN NOT (in_title OR in_heading OR in_url AND (in_text OR named)) THEN 'NO_STRONG_GIFT_CARD_EVIDENCE'
 WHEN NOT (bought OR marked OR found) THEN 'NO_STRONG_PURCHASE_OR_VALUE_EVIDENCE' ELSE 'HTTP_OK_SAME_DOMAIN_STRONG_GIFT_CARD_SEMANTICS_AND_COMMERCE_EVIDENCE' END AS reason FROM s""")
def evidence_decisions(spark, sf):
    """Every page as what was fetched for an item: its address says where it was looked for, and how that ended."""
    url, name = F.col("url"), urls.host(F.col("url"))
    heading = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    rows = table(spark, sf, "pages").select(
        "page_id", "html", F.concat_ws(" ", heading, F.regexp_extract("url", r"/([0-9]+)", 1), F.lit("EUR")).alias("title"), url.alias("item_url"),
        F.concat(F.lit("https://www."), F.when(F.startswith(name, F.lit("blog.")), "writers.example").otherwise(urls.registrable(name))).alias("shop_url"),
        F.when(F.endswith(url, F.lit("#top")), F.regexp_replace(url, "://[^/]*", "://other.example")).otherwise(url).alias("final_url"),
        F.when(F.startswith(url, F.lit("http:")) & F.contains(url, F.lit("/de/")), 404).otherwise(200).alias("status"),
        F.when(F.contains(url, F.lit("utm_source")), "TimeoutError").alias("error"),
    )
    return verify.decide(rows, SIGNS, site=lambda u: urls.registrable(urls.host(u))).select("page_id", "amount", "bucket", "reason")


@query("""
WITH o AS (SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) + INTERVAL 400 DAY AS ends FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
t AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' AND ends > TIMESTAMP '1999-01-01' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'PREMIUM_BANNER' WHEN '2-HIGH' THEN 'FEATURED' WHEN '3-MEDIUM' THEN 'PARTNER' END END AS tier FROM o)
SELECT o_custkey, tier, CASE tier WHEN 'PREMIUM_BANNER' THEN 2 WHEN 'FEATURED' THEN 1 ELSE 0 END AS rank FROM t""")
def subscription_tiers(spark, sf):
    """Customers' tiers by their latest order as a subscription."""
    orders = table(spark, sf, "orders").withColumn("ends", F.date_add(F.col("o_orderdate").cast("date"), 400).cast("timestamp"))
    last = first_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    plans = {"1-URGENT": "PREMIUM_BANNER", "2-HIGH": "FEATURED", "3-MEDIUM": "PARTNER"}
    plan = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in plans.items()])
    tier = curation.tier(plan, F.col("o_orderstatus") == "O", F.col("ends"), F.lit(datetime(1999, 1, 1)).cast("timestamp"))
    return last.select("o_custkey", tier.alias("tier")).select("o_custkey", "tier", curation.tier_rank(F.col("tier")).alias("rank"))


@query("""
WITH e AS (SELECT l_orderkey, count(*) AS lines, max(l_quantity) AS most FROM lineitem GROUP BY 1)
SELECT o_orderkey, lines, most FROM orders JOIN e ON l_orderkey = o_orderkey""")
def complete_evidence(spark, sf):
    """The orders that have lines, each with its line figures: a missing or second row of evidence would be an error."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.max("l_quantity").alias("most"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return linkage.with_evidence(rows, lines, "o_orderkey")
