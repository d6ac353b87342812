"""The whole quality audit, over suppliers as shops and parts as their cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import audit
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()

#: Every rule as (severity, code, table, condition) in SQL.
_RULES = [
    ("MEDIUM", "ACTIVE_MERCHANT_WITHOUT_CARDS", "s", "active AND shop_id NOT IN (SELECT shop_id FROM c)"),
    ("HIGH", "GENERIC_MERCHANT_NAME", "s", "name = 'Gift  Card!'"),
    ("HIGH", "SUSPICIOUS_MERCHANT_NAME", "s", "name = 'www.shop.gr'"),
    ("HIGH", "DUPLICATE_MERCHANT_NAME", "s", "(SELECT count(*) FROM s o WHERE o.name = s.name) > 1"),
    ("HIGH", "DUPLICATE_MERCHANT_DOMAIN", "s", "site <> '' AND (SELECT count(*) FROM s o WHERE o.site = s.site) > 1"),
    ("MEDIUM", "MISSING_MERCHANT_WEBSITE", "s", "active AND url IS NULL"),
    ("MEDIUM", "INVALID_MERCHANT_WEBSITE", "s", "active AND url IS NOT NULL AND site = ''"),
    ("HIGH", "LOGO_MISSING", "s", "logo IS NULL"),
    ("BLOCKER", "LOGO_FAVICON_OR_SITE_ICON", "s", "contains(logo, 'favicon')"),
    ("BLOCKER", "LOGO_PLACEHOLDER_OR_GENERATED", "s", "contains(logo, 'placeholder')"),
    ("MEDIUM", "LOGO_NOT_LOCAL_CANONICAL", "s", "contains(logo, 'cdn')"),
    ("BLOCKER", "LOCAL_LOGO_FILE_MISSING", "s", "contains(logo, 'missing')"),
    ("MEDIUM", "LOGO_SOURCE_DOMAIN_MISMATCH", "s", "logo_source = 'https://elsewhere.org/l.png' AND site <> ''"),
    ("MEDIUM", "NO_OFFICIAL_MERCHANT_SOURCE", "s", "active AND NOT official"),
    ("BLOCKER", "ACTIVE_CARD_IN_INACTIVE_MERCHANT", "c", "live AND NOT active"),
    ("HIGH", "SUSPICIOUS_CARD_TITLE", "c", "p_size = 1"),
    ("HIGH", "DUPLICATE_CARD_TITLE_SAME_MERCHANT", "c", "(SELECT count(*) FROM c o WHERE o.title = c.title AND o.shop_id = c.shop_id) > 1"),
    ("HIGH", "DUPLICATE_OFFICIAL_URL", "c", "p_size IN (13, 14) AND (SELECT count(*) FROM c o WHERE o.p_size = c.p_size AND (c.p_size = 13 OR o.shop_id = c.shop_id)) > 1"),
    ("BLOCKER", "MISSING_OFFICIAL_URL", "c", "p_size = 11"),
    ("MEDIUM", "MISSING_OFFICIAL_URL", "c", "p_size = 5"),
    ("BLOCKER", "INVALID_OFFICIAL_URL", "c", "p_size = 12"),
    ("LOW", "OFFICIAL_URL_TRACKING_PARAMS", "c", "p_size = 13"),
    ("MEDIUM", "VERY_SPECIFIC_OFFICIAL_URL", "c", "p_size = 14"),
    ("HIGH", "OFFICIAL_URL_DOMAIN_MISMATCH", "c", "site <> '' AND card_site <> '' AND card_site <> site"),
    ("HIGH", "ACTIVE_CARD_NOT_VERIFIED", "c", "live AND p_size % 4 = 0"),
    ("HIGH", "ACTIVE_CARD_NEVER_VERIFIED", "c", "p_size = 15"),
    ("MEDIUM", "STALE_VERIFICATION", "c", "p_size > 40"),
    ("HIGH", "NO_OFFICIAL_CARD_SOURCE", "c", "p_size = 18"),
    ("MEDIUM", "NO_CATEGORY", "c", "p_size = 19"),
    ("LOW", "NO_OCCASION", "c", "p_size = 20"),
    ("MEDIUM", "NO_ACTIVE_VARIANT", "c", "p_size = 21"),
    ("HIGH", "INVALID_VARIANT_PURCHASE_URL", "c", "p_size = 22"),
    ("MEDIUM", "VARIANT_PURCHASE_DOMAIN_MISMATCH", "c", "p_size = 23 AND site <> ''"),
    ("LOW", "MISSING_SEO_TITLE", "c", "p_size = 16"),
    ("LOW", "MISSING_META_DESCRIPTION", "c", "p_size = 17"),
    ("HIGH", "OPEN_PRODUCTION_REVIEW_FLAG", "c", "p_size = 24"),
    ("HIGH", "LATEST_SNAPSHOT_BAD_HTTP", "c", "p_size = 25"),
]
_CATALOGUE = """
WITH s AS (SELECT *, regexp_extract(coalesce(url, ''), '^https://([^/]+)', 1) AS site FROM (SELECT s_suppkey AS shop_id, s_acctbal > 0 AS active, s_acctbal < 6000 AS official, CASE WHEN s_acctbal > 9500 THEN 'Gift  Card!' WHEN s_acctbal > 9000 THEN 'www.shop.gr' WHEN s_acctbal > 8500 THEN 'Twin' ELSE s_name END AS name,
  CASE WHEN s_nationkey < 3 THEN NULL WHEN s_nationkey = 3 THEN 'not a url' WHEN s_nationkey = 4 THEN 'https://same.example/' ELSE 'https://s' || s_suppkey || '.example/' END AS url,
  CASE s_nationkey WHEN 5 THEN NULL WHEN 6 THEN '/favicon.ico' WHEN 7 THEN 'https://x.example/placeholder.png' WHEN 8 THEN 'https://cdn.example/l.png' WHEN 9 THEN '/merchant-logos/missing.png' ELSE '/merchant-logos/' || s_suppkey || '.png' END AS logo,
  CASE WHEN s_nationkey >= 10 THEN 'https://elsewhere.org/l.png' END AS logo_source FROM supplier)),
c AS (SELECT p_partkey AS card_id, p_size, p_size > 5 AS live, s.*, CASE p_size WHEN 1 THEN 'http://x' WHEN 2 THEN 'Shared title' ELSE p_name || ' ' || p_partkey END AS title,
  CASE WHEN p_size IN (5, 11, 12) THEN '' WHEN p_size = 13 THEN 'same.example' ELSE 's' || shop_id || '.example' END AS card_site FROM part JOIN s ON shop_id = p_partkey % (SELECT count(*) FROM supplier))
"""


@query(_CATALOGUE + "SELECT severity, code, n, affected FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS code, count(*) AS n, count(DISTINCT {'shop_id' if t == 's' else 'card_id'}) AS affected FROM {t} WHERE {w}" for s, c, t, w in _RULES) + ") WHERE n > 0")
def quality_audit(spark, sf):
    """Issues and affected entities by code: every rule, from one pass over each table."""
    found = audit.audit(**_catalogue(spark, sf))
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct("entity", "id").alias("affected"))


@query(_CATALOGUE + ", i AS (" + " UNION ALL ".join(f"SELECT '{'MERCHANT' if t == 's' else 'GIFT_CARD'}' AS entity, {'shop_id' if t == 's' else 'card_id'} AS id, '{s}' AS severity FROM {t} WHERE {w}" for s, c, t, w in _RULES)
 + ") SELECT entity, count(*) FILTER (severity = 'BLOCKER') AS errors, count(*) FILTER (severity <> 'BLOCKER') AS warnings, count(DISTINCT id) AS affected FROM i GROUP BY 1")
def production_validation(spark, sf):
    """Errors and warnings before a catalogue is published."""
    return audit.blockers(audit.audit(**_catalogue(spark, sf)))


def _catalogue(spark, sf) -> dict:
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    balance, nation, key = F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("/merchant-logos/"), key, F.lit(".png"))
    shops = supplier.select(
        F.col("s_suppkey").alias("shop_id"),
        F.when(balance > 9500, "Gift  Card!").when(balance > 9000, "www.shop.gr").when(balance > 8500, "Twin").otherwise(F.col("s_name")).alias("name"),
        F.when(balance > 0, "ACTIVE").otherwise("ARCHIVED").alias("status"),
        F.when(nation < 3, F.lit(None)).when(nation == 3, "not a url").when(nation == 4, "https://same.example/").otherwise(F.concat(F.lit("https://s"), key, F.lit(".example/"))).alias("url"),
        F.when(nation == 5, F.lit(None)).when(nation == 6, "/favicon.ico").when(nation == 7, "https://x.example/placeholder.png").when(nation == 8, "https://cdn.example/l.png").when(nation == 9, "/merchant-logos/missing.png").otherwise(own).alias("logo"),
        F.when(nation >= 10, "https://elsewhere.org/l.png").alias("logo_source"),
    )
    size, shop = F.col("p_size"), F.col("p_partkey") % supplier.count()
    host = F.concat(F.lit("https://s"), shop.cast("string"), F.lit(".example"))
    cards = part.select(
        F.col("p_partkey").alias("card_id"),
        shop.cast("int").alias("shop_id"),
        F.when(size == 1, "http://x").when(size == 2, "Shared title").otherwise(F.concat_ws(" ", "p_name", "p_partkey")).alias("title"),
        F.when(size > 5, "ACTIVE").otherwise("DRAFT").alias("status"),
        F.when(size % 4 == 0, "NEEDS_REVIEW").otherwise("VERIFIED").alias("verification"),
        F.when(size.isin(5, 11), F.lit(None)).when(size == 12, "nope").when(size == 13, "https://same.example/a?utm_source=x").when(size == 14, F.concat(host, F.lit("/gift-card/50"))).otherwise(F.concat(host, F.lit("/p/x"), F.col("p_partkey").cast("string"))).alias("url"),
        F.when(size == 15, F.lit(None)).otherwise(F.to_timestamp(F.when(size > 40, "2023-01-01").otherwise("2024-01-20"))).alias("verified_at"),
        F.when(size != 16, F.col("p_name")).alias("seo_title"),
        F.when(size != 17, F.col("p_type")).alias("meta"),
    )
    ids = part.select(F.col("p_partkey").alias("card_id"), "p_size")
    official = supplier.filter("s_acctbal < 6000").select(F.col("s_suppkey").alias("shop_id"), F.lit(None).cast("int").alias("card_id"), F.lit("OFFICIAL").alias("kind"))
    of_cards = ids.select(F.lit(None).cast("int").alias("shop_id"), "card_id", F.when(size != 18, "OFFICIAL").otherwise("FORUM").alias("kind"))
    seen = lambda day, status: F.struct(F.to_timestamp(F.lit(day)).alias("observed_at"), status.alias("http_status"))
    snapshots = ids.select("card_id", F.inline(F.array(seen("2024-01-01", F.when(size == 26, 404).otherwise(200)), seen("2024-01-09", F.when(size == 25, 404).otherwise(301)))))
    return {
        "shops": shops,
        "cards": cards,
        "sources": official.unionByName(of_cards),
        "variants": ids.select(F.col("card_id").alias("variant_id"), "card_id", (size != 21).alias("active"), F.when(size == 22, "bad").when(size == 23, "https://elsewhere.org/v").alias("url")),
        "categories": ids.filter("p_size != 19"),
        "occasions": ids.filter("p_size != 20"),
        "flags": ids.filter("p_size = 24").select("card_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("reason")),
        "snapshots": snapshots,
        "files": shops.select(F.concat(F.lit("/merchant-logos/"), F.col("shop_id").cast("string"), F.lit(".png")).alias("path")),
        "rules": audit.AuditRules(F.to_timestamp(F.lit("2024-02-01")), ("gift card", "shop", "store")),
    }
